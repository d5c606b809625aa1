"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mktstream.llm.common import written

#: 1: the word counts, 0: any word may stand there. Every overlap of MIN_WORDS words or more with MIN_SHARE equal
#: holds one of these, wherever its other words stand.
MASKS = ("1111011", "110100010011", "110101011", "1110111")
MIN_WORDS = 13
MIN_SHARE = 0.8
BLOCK_WORDS = 2_000_000
CHUNK_WORDS = 16_384
CACHE_WORDS = 100_000
#: A seed that stands at more places of items is looked up by distances.
OFTEN = 64
FILTER_BITS = 22
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class WordHashes(dict):
    """64-bit hashes of words without case and without punctuation at their ends; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        bare = _EDGES.sub("", word)
        value = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "replace")) | 1) if bare else 0
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words that the mask keeps, at each place where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def least_equal(n: int) -> int:
    """How many of n words must be equal."""
    return next(k for k in range(n + 1) if k >= MIN_SHARE * n - 1e-9)


def masks_of(n: int) -> tuple[str, ...]:
    """Masks of which each overlap with an item of n words holds one.

    An item under MIN_WORDS of which m words may differ is cut into m + 2 parts: two of them stay equal.
    """
    if n >= MIN_WORDS or not n:
        return MASKS if n else ()
    m = n - least_equal(n)
    if not m:
        return ("1" * n,)
    cuts = [n * i // (m + 2) for i in range(m + 3)]
    return tuple("".join("1" if k in (i, j) else "0" for k in range(m + 2) for _ in range(cuts[k], cuts[k + 1])) for i, j in combinations(range(m + 2), 2))


class Benchmark:
    """The seeds of a block of benchmark items, sorted, with a bit filter in front."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(text) for _, text in items]
        keys, item, at, which = [], [], [], []
        self.masks = sorted({m for n in {len(w) for w in self.words} for m in masks_of(n)})
        for t, w in enumerate(self.words):
            for m in masks_of(len(w)):
                s = seeds(w, m)
                keys.append(s)
                item.append(np.full(len(s), t))
                at.append(np.arange(len(s)))
                which.append(np.full(len(s), self.masks.index(m)))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        keys, item, at, which = join(keys, np.uint64), join(item, np.int64), join(at, np.int64), join(which, np.int64)
        self.tables = []
        for m in range(len(self.masks)):
            own = which == m
            order = np.argsort(keys[own], kind="stable")
            k = keys[own][order]
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[k >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((k, item[own][order], at[own][order], bits))

    def hits(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of text, item and place of the item's first word in the text, one of all seeds that texts share with items.

        h has the words of all texts, each from its start on. A seed over the end of a text only proposes in vain.
        """
        found = [np.zeros((0, 3), np.int64)]
        for mask, (keys, item, at, bits) in zip(self.masks, self.tables):
            s = seeds(h, mask)
            places = np.flatnonzero(bits[s >> np.uint64(64 - FILTER_BITS)])
            if not len(places):
                continue
            lo, hi = np.searchsorted(keys, s[places], "left"), np.searchsorted(keys, s[places], "right")
            often = hi - lo > OFTEN
            if often.any():
                found += [self.often(places[often & (lo == k)], starts, item[k:e], at[k:e]) for k, e in sorted({*zip(lo[often].tolist(), hi[often].tolist())})]
                places, lo, hi = places[~often], lo[~often], hi[~often]
            n = hi - lo
            seed = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(places, n)
            text = np.searchsorted(starts, place, "right") - 1
            found.append(np.unique(np.stack([text, item[seed], place - starts[text] - at[seed]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    @staticmethod
    def often(places: np.ndarray, starts: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """hits() of one seed that stands at many places of items, as where a word or a phrase goes on and on.

        Of the places in a text and in an item only the distances count, and there are no more of these than the two have words;
        a convolution tells which there are without going through all pairs.
        """
        out = [np.zeros((0, 3), np.int64)]
        text = np.searchsorted(starts, places, "right") - 1
        for t in np.unique(text):
            here = places[text == t] - starts[t]
            for i in np.unique(item):
                d = distances(here, at[item == i])
                out.append(np.stack([np.full(len(d), t), np.full(len(d), i), d], 1))
        return np.concatenate(out)

    def overlaps(self, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text item -> (place, words, equal words) of its longest overlap with it that passes."""
        hs = [word_hashes(text) for text in texts]
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not any(map(len, hs)):
            return best
        starts = np.cumsum([0, *map(len, hs[:-1])])
        for i, t, first in self.hits(np.concatenate(hs), starts).tolist():
            h, w, mine = hs[i], self.words[t], best[i]
            a, b = max(0, -first), min(len(w), len(h) - first)
            if b - a < min(MIN_WORDS, len(w)):
                continue
            same = h[first + a : first + b] == w[a:b]
            if len(w) < MIN_WORDS:
                start, n, equal = 0, len(w), int(same.sum())
                passes = equal >= least_equal(n)
            else:
                start, n, equal = longest(same)
                passes = n >= MIN_WORDS
            if passes and (t not in mine or (n, equal) > mine[t][1:]):
                mine[t] = (first + a + start, n, equal)
        return best

    def overlaps_of(self, column: pa.Array) -> Iterator[dict[int, tuple[int, int, int]]]:
        """overlaps() of a column of texts, about CHUNK_WORDS words (by spaces) at once."""
        held, n = [], 0
        for v in column:
            text = v.as_py() or ""
            held.append(text)
            n += text.count(" ") + 1
            if n >= CHUNK_WORDS:
                yield from self.overlaps(held)
                held, n = [], 0
        yield from self.overlaps(held)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct differences between elements of a and of b."""
    if len(a) * len(b) <= 1 << 16:
        return np.unique(a[:, None] - b[None, :])
    low, high = a.min(), b.max()
    x, y = np.zeros(a.max() - low + 1), np.zeros(high - b.min() + 1)
    x[a - low], y[high - b] = 1, 1
    n = len(x) + len(y) - 1
    both = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)
    return np.flatnonzero(both > 0.5) + low - high


def longest(same: np.ndarray) -> tuple[int, int, int]:
    """Start, length and number of equal places of the longest run that starts and ends equal with MIN_SHARE equal."""
    ones = np.flatnonzero(same)
    if not len(ones):
        return 0, 0, 0
    # A run from ones[i] to ones[j] has j - i + 1 equal places; it passes if balance[j] + 1 >= balance[i] scaled.
    rank = np.arange(len(ones))
    end_balance = rank + 1 - MIN_SHARE * (ones + 1)
    start_balance = rank - MIN_SHARE * ones
    lowest = np.minimum.accumulate(start_balance)
    # The earliest start whose balance is not above the end's: lowest never rises, so search it reversed.
    i = np.searchsorted(-lowest, -(end_balance + 1e-9), "left")
    ok = i <= rank
    length = np.where(ok, ones - ones[np.minimum(i, len(ones) - 1)] + 1, 0)
    j = int(length.argmax())
    start = int(i[j])
    return int(ones[start]), int(length[j]), j - start + 1


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """The items in blocks of about BLOCK_WORDS words. They come through the driver partition by partition, which holds two blocks at most."""
    held, n = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        if row[1]:
            held.append((row[0], row[1]))
            n += row[1].count(" ") + 1
        if n >= BLOCK_WORDS:
            yield Benchmark(held)
            held, n = [], 0
    if held:
        yield Benchmark(held)


def arrow_of(schema: T.StructType, name: str) -> pa.DataType:
    return to_arrow_type(schema[name].dataType)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs and benchmark item that it overlaps: the longest overlap.

    Returns id_col, item_col, first_word (of the overlap in the text, words that are only punctuation not
    counted), n_words and n_equal. Words are compared without case and outer punctuation; at least MIN_WORDS
    words from an equal one to an equal one, of which MIN_SHARE are equal, make an overlap; of a shorter item
    all its words are compared, of which MIN_SHARE must be equal. Spaced seeds propose all such places. Of overlaps of an item that
    tie in words and equal words one is given. Null and empty texts and items overlap nothing; repeated
    rows report each; an empty table gives no rows; long texts are read whole; further columns aren't read.

    Each block of the benchmark is one pass over docs without a shuffle. If there are several, what each finds is
    written before the next one is made, so one block at a time is held.
    """
    fields = [docs.schema[id_col], benchmark.schema[item_col], *(T.StructField(n, T.LongType()) for n in ("first_word", "n_words", "n_equal"))]
    names, item_type = [f.name for f in fields], arrow_of(benchmark.schema, item_col)
    rows = docs.select(id_col, text_col)

    def against(shared: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                at, found = [], []
                for i, overlaps in enumerate(own.overlaps_of(batch.column(1))):
                    for t, overlap in overlaps.items():
                        at.append(i)
                        found.append((own.ids[t], *overlap))
                columns = [pa.array([f[k] for f in found], pa.int64() if k else item_type) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

        return rows.mapInArrow(run, T.StructType(fields))

    parts = []
    for shared, last in shared_blocks(benchmark, item_col, item_text_col):
        parts.append(against(shared) if last else written(against(shared), "overlaps"))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], T.StructType(fields))


def shared_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """Each block as a broadcast, and whether it is the last. All but the last are gone when the next one is asked for."""
    context, held = benchmark.sparkSession.sparkContext, None
    for block in blocks_of(benchmark, id_col, text_col):
        if held is not None:
            shared = context.broadcast(held)
            yield shared, False
            shared.destroy()
        held = block
    if held is not None:
        yield context.broadcast(held), True


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns, whatever their names.

    Overlaps are those of contaminations(). Null and empty texts stay; repeated rows stay or go together; an empty table
    stays empty; long texts are read whole. Each block of the benchmark but the last writes what it leaves.
    """

    def past(rows: DataFrame, shared: Broadcast) -> DataFrame:
        at = rows.columns.index(text_col)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not overlaps for overlaps in shared.value.overlaps_of(batch.column(at))], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for shared, last in shared_blocks(benchmark, item_col, item_text_col):
        docs = past(docs, shared) if last else written(past(docs, shared), "without-block")
    return docs
