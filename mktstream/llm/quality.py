"""Quality classifier by hierarchical empirical Bayes over documents, hosts and paths."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mktstream.llm.common import counted, dropped, free_names, written

_PUNCT = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_DIGITS = b"0123456789"
_CAPITALS = bytes(range(0x41, 0x5B))
BINS = 12
N_FEATURES = 9
#: The classifier is fitted on about so many labelled rows at most, drawn by hash.
SAMPLE = 50_000
RIDGE = 1.0
NEWTON_STEPS = 25
#: A document stays from this posterior on.
THRESHOLD = 0.3
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0


def _share_bin(x: float) -> int:
    """0 for none, then by powers of two up to all."""
    return 0 if x <= 0 else max(1, BINS - 1 + math.ceil(math.log2(min(x, 1.0))))


def features(text: str) -> list[int]:
    """Bins of: words, distinct words, words that repeat the one before, word length, punctuation, digits, capitals, repeated lines, words of punctuation alone."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0] * N_FEATURES
    lines = [line for line in data.split(b"\n") if line.strip()]
    bare = data.translate(None, _PUNCT)
    repeats = sum(map(operator.eq, words, words[1:])) / n
    return [
        min(BINS - 1, n.bit_length()),
        _share_bin(len(set(words)) / n / (1 if n < 200 else min(1.0, (200 / n) ** 0.35))),
        _share_bin(repeats),
        min(BINS - 1, int(size / n)),
        _share_bin((size - len(bare)) / size),
        _share_bin((size - len(data.translate(None, _DIGITS))) / size),
        _share_bin((size - len(data.translate(None, _CAPITALS))) / size),
        _share_bin(1 - len(set(lines)) / len(lines)),
        _share_bin(1 - len(bare.split()) / n),
    ]


def with_bins(rows: DataFrame, text_col: str, bins_col: str = "bins", keep_text: bool = True) -> DataFrame:
    """rows and the features of the text; without keep_text the text goes."""
    at = rows.columns.index(text_col)
    stay = [i for i in range(len(rows.columns)) if keep_text or i != at]
    schema = T.StructType([rows.schema[i] for i in stay] + [T.StructField(bins_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = pa.array([features(v.as_py() or "") for v in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), bins], schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Sites:
    """What the corpus says of hosts and paths: sums of first posteriors, and how strongly each level shrinks."""

    log_odds: list[list[float]]
    prior: float
    host: DataFrame
    path: DataFrame
    host_strength: float
    path_strength: float


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def evidence(bins: Column, log_odds: list[list[float]]) -> Column:
    """The log-likelihood ratio of the features."""
    parts = [F.element_at(F.array(*[F.lit(x) for x in row]), bins[i] + 1) for i, row in enumerate(log_odds)]
    return sum(parts[1:], parts[0])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic(bins: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on one indicator for each bin, by Newton's method: weights and intercept."""
    x = np.zeros((len(bins), N_FEATURES * BINS + 1))
    x[np.arange(len(bins))[:, None], np.arange(N_FEATURES) * BINS + bins] = 1.0
    x[:, -1] = 1.0
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (good - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].reshape(N_FEATURES, BINS), float(w[-1])


def classifier(bins: DataFrame, labels: DataFrame) -> tuple[list[list[float]], float]:
    """Log-likelihood ratios by feature and bin, and the share of good ones among all labelled rows of bins (id, bins).

    Weights come from a sample of SAMPLE rows or so, up to half of them of each class, however rare it is; the
    sample's odds of the classes, which the weights hold too, are taken out of them.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__q"))
    rows = bins.join(known, F.col("id") == F.col("__id"))
    count = {r["__q"]: r["count"] for r in rows.groupBy("__q").count().collect()}
    bad, good = count.get(0, 0), count.get(1, 0)
    prior = (good + 1) / (good + bad + 2)
    if not bad or not good:
        return [[0.0] * BINS] * N_FEATURES, prior
    share = F.when(F.col("__q") == 1, SAMPLE / 2 / good).otherwise(SAMPLE / 2 / bad)
    drawn = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < share * 1_000_000).select("bins", "__q").collect()
    y = np.array([r["__q"] for r in drawn], float)
    if not 0 < y.sum() < len(y):
        raise ValueError(f"a class is missing among {len(y)} drawn rows of {good} good and {bad} bad ones")
    weights, intercept = logistic(np.array([r["bins"] for r in drawn]), y)
    base = (intercept - _logit(y.mean())) / N_FEATURES
    return [[float(v) + base for v in row] for row in weights], prior


def strength(sites: DataFrame, rate: Column) -> float:
    """How many documents the level above counts for, by the method of moments over the sites of one level.

    Sites vary about `rate` beyond what the number of their documents explains; the less, the stronger.
    """
    r = sites.select(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("within"),
        F.sum(F.col("n") * (F.col("k") / F.col("n") - rate) ** 2).alias("between"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not r.n or r.sites < 2:
        return MOST_STRENGTH
    mean = r.within / r.n
    excess = (r.between - r.sites * mean) / r.n
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, mean / excess - 1)) if excess > 0 else MOST_STRENGTH


def site_key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), value.cast("string")), F.lit("-"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without www and port; null if there is none."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)


def path_of(url: Column) -> Column:
    """The first directory of a URL's path, empty for the root."""
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]*)/", 1)


@dataclass
class Keys:
    """What tells a document's host, and the path below it: columns, or one column with its URL."""

    host: str = "source"
    path: str = "lang"
    url: str | None = None

    def columns(self) -> list[Column]:
        host, path = (host_of(F.col(self.url)), path_of(F.col(self.url))) if self.url else (F.col(self.host), F.col(self.path))
        return [site_key(host).alias("host"), site_key(path).alias("path")]


def binned(docs: DataFrame, id_col: str, text_col: str, keys: Keys) -> tuple[DataFrame, int]:
    """id, host, path and bins of each row, written, and their number."""
    table, seen = counted(with_bins(docs.select(F.col(id_col).alias("id"), *keys.columns(), F.col(text_col).alias("text")), "text", keep_text=False), "quality-bins")
    return table, seen["rows"]


def fit(bins: DataFrame, rows: int, labels: DataFrame) -> Sites:
    """The classifier from labelled rows; sums over all rows of bins for hosts and for paths below them."""
    log_odds, prior = classifier(bins, labels)
    p = sigmoid(evidence(F.col("bins"), log_odds) + F.lit(_logit(prior)))
    path = bins.groupBy("host", "path").agg(F.sum(p).alias("k"), F.count(F.lit(1)).alias("n"))
    path, seen = counted(path, "quality-path", rows=rows)
    host = written(path.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "quality-host", rows=seen["rows"])
    total = host.agg(F.sum("k"), F.sum("n")).first()
    rate = total[0] / total[1] if total[1] else prior
    host_strength = strength(host, F.lit(rate))
    above = host.select("host", ((F.col("k") + host_strength * rate) / (F.col("n") + host_strength)).alias("rate"))
    path_strength = strength(path.join(above, "host"), F.col("rate"))
    return Sites(log_odds, rate if 0 < rate < 1 else prior, host, path, host_strength, path_strength)


def posteriors(rows: DataFrame, sites: Sites) -> tuple[DataFrame, Column, Column]:
    """rows (with host, path and bins as the last columns), joined to their sites, and the columns p_site and p_quality.

    p_site is the path's rate shrunk toward its host's, which is shrunk toward the global rate, both without
    the document itself; p_quality combines it with the document's evidence. The site tables have a row for
    each host and path; Spark broadcasts them while they are below its threshold and shuffles them beyond.
    """
    host_col, path_col, bins_col = rows.columns[-3:]
    own = free_names(rows.columns, "of_host", "hk", "hn", "at_host", "at_path", "pk", "pn")
    of_host, hk, hn, at_host, at_path, pk, pn = own
    host = sites.host.toDF(of_host, hk, hn)
    path = sites.path.toDF(at_host, at_path, pk, pn)
    rows = rows.join(host, F.col(host_col) == F.col(of_host), "left").join(path, (F.col(host_col) == F.col(at_host)) & (F.col(path_col) == F.col(at_path)), "left")
    e = evidence(F.col(bins_col), sites.log_odds)
    p = sigmoid(e + F.lit(_logit(sites.prior)))
    less = F.least(F.coalesce(pn, F.lit(0)), F.lit(1))
    hk_, hn_ = F.greatest(F.coalesce(hk, F.lit(0.0)) - p * less, F.lit(0.0)), F.coalesce(hn, F.lit(0)) - less
    pk_, pn_ = F.greatest(F.coalesce(pk, F.lit(0.0)) - p * less, F.lit(0.0)), F.coalesce(pn, F.lit(0)) - less
    h = (hk_ + sites.host_strength * sites.prior) / (hn_ + sites.host_strength)
    site = F.least(F.greatest((pk_ + sites.path_strength * h) / (pn_ + sites.path_strength), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows, site, sigmoid(e + F.ln(site / (1 - site)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keys: Keys = Keys()) -> DataFrame:
    """id_col, p_site, p_quality and keep (p_quality at threshold or above) for each row of docs.

    keys: a document's host and path, from columns or from its URL; the tables know no URL of documents, so by default
    the source is the host and the language the path below. Null hosts and
    paths are sites of their own; null and empty texts are documents without words; labels that are null or
    neither 0 nor 1 don't count, and without labels of both classes all rests on even odds. Repeated rows count each, an
    empty table gives no rows, long texts are read whole, further columns aren't read. Ties at the threshold are kept.
    """
    bins, n = binned(docs, id_col, text_col, keys)
    rows, site, p = posteriors(bins, fit(bins, n, labels))
    out = rows.select(F.col("id").alias(id_col), site.alias("p_site"), p.alias("p_quality"))
    return out.withColumn("keep", F.col("p_quality") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keys: Keys = Keys()) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names.

    Null, empty and long texts, null hosts and repeated rows are rated as there; an empty table stays empty. Features are
    taken a second time as the rows pass, which is cheaper than writing all texts once more.
    """
    rated, n = binned(docs, id_col, text_col, keys)
    model = fit(rated, n, labels)
    dropped(rated)
    host, path, bins = free_names(docs.columns, "host_key", "path_key", "bins")
    of_host, of_path = keys.columns()
    rows = with_bins(docs.withColumn(host, of_host).withColumn(path, of_path), text_col, bins)
    rows, _, p = posteriors(rows, model)
    return rows.where(p >= threshold).select(*docs.columns)
