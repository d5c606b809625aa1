"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.llm.vectors import summed

BUCKETS = 1 << 16
WINDOW = 32
ROUNDS = 15
#: More than so many values of the language column are taken for an error in the table.
MOST_VALUES = 10_000
PENALTY = 2.0
SMOOTHING = 0.5
FLUSH_WINDOWS = 200_000

# A-Z and a-z stay, other ASCII becomes a blank, bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def grams(text: str) -> np.ndarray:
    """The bucket of every four-byte gram of the lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_FOLD), dtype=np.uint8).astype(np.uint32)
    if len(b) < 4:
        b = np.concatenate([b, np.full(4 - len(b), 0x20, np.uint32)])
    code = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Mixture:
    """Gram log-likelihoods of each language, and inference of a text's languages and their proportions."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32).copy()

    def windows(self, text: str) -> np.ndarray:
        """Log-likelihood of each run of WINDOW grams under each language."""
        each = self.logp[grams(text)]
        return np.add.reduceat(each, np.arange(0, len(each), WINDOW), axis=0).astype(np.float64)

    def infer(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its main language and that one's proportion, all texts at once.

        Expectation-maximisation with all languages ranks them; then the first 1, 2, ... of that ranking are
        fitted alone, as long as the likelihood less PENALTY * log(windows) a language rises. Of languages that
        tie the first in alphabetical order is ahead.
        """
        sizes = np.array([len(w) for w in windows])
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = np.concatenate(windows)
        top = x.max(axis=1, keepdims=True)
        like, base = np.exp(x - top), np.add.reduceat(top[:, 0], start)
        doc, n, k = np.repeat(np.arange(len(sizes)), sizes), len(sizes), x.shape[1]

        def fit(of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and likelihood of the texts of numbers `of`, each with its allowed languages."""
            own = np.flatnonzero(np.isin(doc, of)) if len(of) < n else slice(None)
            some, size = like[own], sizes[of]
            at = np.repeat(np.arange(len(of)), size)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            share = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                r = share[at] * some
                r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
                share = np.add.reduceat(r, first, axis=0) / size[:, None]
            fitted = np.log(np.maximum((share[at] * some).sum(axis=1), 1e-300))
            return share, base[of] + np.add.reduceat(fitted, first)

        rising = np.arange(n)
        order = np.argsort(-fit(rising, np.ones((n, k)))[0], axis=1, kind="stable")
        best = np.full(n, -np.inf)
        lang, score = np.zeros(n, np.int64), np.zeros(n)
        for m in range(1, k + 1):
            allowed = np.zeros((len(rising), k))
            np.put_along_axis(allowed, order[rising, :m], 1.0, axis=1)
            share, fitted = fit(rising, allowed)
            value = fitted - PENALTY * m * np.log(1 + sizes[rising])
            better = value > best[rising]
            rising, share, value = rising[better], share[better], value[better]
            if not len(rising):
                break
            best[rising], lang[rising], score[rising] = value, share.argmax(axis=1), share.max(axis=1)
        return lang, score


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """Gram counts by language over all rows of docs whose language and text are known."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(MOST_VALUES + 1).collect())
    if len(languages) > MOST_VALUES:
        raise ValueError(f"{lang_col} has more than {MOST_VALUES} values, so it holds no languages")
    at = {v: i * BUCKETS for i, v in enumerate(languages)}

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for text, lang in zip(batch.column(0), batch.column(1)):
            i = at[lang.as_py()]
            total[i : i + BUCKETS] += np.bincount(grams(text.as_py()), minlength=BUCKETS)

    counts = summed(known, len(languages) * BUCKETS, count) if languages else np.zeros(0)
    return Mixture(languages, counts.reshape(len(languages), BUCKETS))


def identify(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score (the proportion of the predicted language) for each row.

    Only the text decides. A null text, or one without a letter, is `und` with score 0, as is every text if
    the model knows no language. Very long texts are read whole, in windows; repeated rows are rated each;
    an empty table gives no rows; further columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = ["und"] * len(batch), [0.0] * len(batch)
            at: list[int] = []
            windows: list[np.ndarray] = []
            held = 0

            def flush() -> None:
                if windows:
                    for i, lang, score in zip(at, *model.infer(windows)):
                        langs[i], scores[i] = model.languages[lang], min(1.0, float(score))
                at.clear()
                windows.clear()

            for i, value in enumerate(batch.column(2)):
                text = value.as_py()
                if model.languages and has_letter(text):
                    at.append(i)
                    windows.append(model.windows(text))
                    held += len(windows[-1])
                    if held >= FLUSH_WINDOWS:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    names = [id_col, "held_out", "lang_pred", "score"]
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
