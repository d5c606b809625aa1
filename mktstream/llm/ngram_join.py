"""N-gram Jaccard self-join by signature trees.

Every linked pair must share one of the rarest shingles of either text (prefix filter, order by a count
sketch of all shingles). Signature trees are used twice. Over the sets that share such a shingle, a tree of
their bitmaps finds the pairs that may link; pairs that are connected form a block. Inside a block a tree
finds the links themselves. A tree's nodes hold OR-combined bitmaps and size ranges, and a traversal of two
trees drops pairs of nodes by the largest overlap that they could have.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mktstream.llm.common import broadcast_below, counted, dropped, few, free_names, in_rounds, planned_once, small_batches, tidy, written
from mktstream.llm.graph import Forest, contracted, stars, with_roots
from mktstream.llm.vectors import summed

SKETCH_BITS = 20
FAN_OUT = 8
#: A set's bitmap has twice as many bits as elements, between these.
LEAST_BITS, MOST_BITS = 256, 1 << 15
#: A block with more sets, or with more shingles in them, is dealt out in chunks of about so many.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Rows of texts or bitmaps that a task turns into Python values at once.
SLICE = 256
#: Up to so many sets are compared one by one rather than by a tree, and so many tested pairs are remembered.
FEW, TESTED = 4, 300_000
FILTER_BITS = 24
#: Chunks that are compared take about so many bytes of bitmaps, or so many shingles of texts, to the disk at once, or four times the bitmaps of all chunks.
ROUND_BYTES, ROUND_SHINGLES = 1 << 28, 1 << 26
#: Bitmaps of postings take at most about so many bytes of the disk at once, or so many times the bitmaps of all sets.
POSTING_BYTES, POSTING_TIMES = 1 << 30, 8
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; texts link from a Jaccard similarity of num / den."""

    words: int
    num: int
    den: int

    def least_overlap(self, n: int) -> int:
        """What a set of n shares at least with any that it links to."""
        return -(-self.num * n // self.den)

    def needed(self, total: int) -> int:
        """The least intersection of two linked sets with so many elements together."""
        return -(-self.num * total // (self.num + self.den))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles: all runs of so many words; of a shorter text, all its words."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out = np.sort(out)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def bits_for(n: int) -> int:
    bits = LEAST_BITS
    while bits < 2 * n and bits < MOST_BITS:
        bits *= 2
    return bits


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each element by its low bits; halves laid over each other give the bitmap of half the bits."""
    flags = np.zeros(bits, np.uint8)
    flags[h & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def sketch(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How often the shingles of each of 2^SKETCH_BITS buckets occur in the texts (its one column)."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        held, n = [], 0
        for i, v in enumerate(batch.column(0)):
            held.append(shingles(v.as_py(), rule.words) >> np.uint64(64 - SKETCH_BITS))
            n += len(held[-1])
            if n > 1_000_000 or i == len(batch) - 1:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << SKETCH_BITS)
                held, n = [], 0

    return summed(docs, 1 << SKETCH_BITS, count)


def prefix(h: np.ndarray, counts: np.ndarray, rule: Rule) -> np.ndarray:
    """The rarest shingles of a set, one more than it may lack: linked sets share one of these.

    The order is by the count of the shingle's bucket, then by the shingle; those that tie with the last by
    the compared bits come along, which only adds candidates.
    """
    n = len(h)
    p = n - rule.least_overlap(n) + 1
    if p >= n:
        return h
    rare = counts[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    return h[rare <= np.partition(rare, p - 1)[p - 1]]


def signatures(docs: DataFrame, counts: np.ndarray, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """doc, n (size of the set), set (128-bit hash of it), sid (its first 64 bits), bits (its bitmap) and tokens (the prefix)."""
    counts = np.minimum(counts, (1 << 31) - 1).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, sids, maps, tokens = [], [], [], [], []
            for v in batch.column(1):
                h = shingles(v.as_py(), rule.words)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                sizes.append(len(h))
                sets.append(digest)
                sids.append(int.from_bytes(digest[:8], "big", signed=True))
                maps.append(bitmap(h, bits_for(len(h))).tobytes())
                tokens.append(prefix(h, shared.value, rule).view(np.int64) if len(h) else np.zeros(0, np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sids, pa.int64()), pa.array(maps, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc", "n", "set", "sid", "bits", "tokens"]
    fields = [T.StructField("doc", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("sid", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def token_filter(tokens: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set for the tokens of the one column: false positives are possible, misses are not."""

    def mark(batch: pa.RecordBatch, words: np.ndarray) -> None:
        at = filter_bits(np.asarray(batch.column(0)))
        np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63))

    return summed(tokens, 1 << (FILTER_BITS - 6), mark, np.bitwise_or)


def filter_bits(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.int64(20)) & np.int64((1 << FILTER_BITS) - 1)


def spread_where(table: DataFrame, words: np.ndarray) -> DataFrame:
    """(token, sid, n) of the prefix tokens that pass the filter."""
    shared = table.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            tokens = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            at = filter_bits(tokens)
            stay = (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            place = pa.array(row[stay])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[stay]), batch.column(0).take(place), batch.column(1).take(place)], ["token", "sid", "n"])

    return table.select("sid", "n", "tokens").mapInArrow(run, "token bigint, sid bigint, n bigint")


def blocks(table: DataFrame, sets: DataFrame, rule: Rule, limit: int, tokens: int, bytes_: int) -> DataFrame:
    """Stars (u, v) of sids: sets that may link, directly or through others, lie under one v; others are left out.

    A prefix shingle of two sets is a pair at once. For one of more, a signature tree over the bitmaps of its
    sets gives the pairs that may link, less those that connect nothing new. One of more than `limit` sets
    ties all its sets to the smallest instead, which only makes the block larger: one row for each set,
    none for each pair; the trees inside the block then see to the pairs. Smallest and largest are partial
    aggregates, and copies of a set have one sid, so a hot shingle comes to its task as a row from each task
    before. Rows of shingles of one or two sets don't travel again: a bit filter of fixed size leaves them
    out before the second shuffle. Bitmaps go only to sets that share the shingle with one whose size allows a link.
    Shingles are dealt out over rounds by a bound of the bitmaps that go, as more and more sets share one by chance as tables
    grow. tokens: how many rows the prefixes have in all; bytes_: what the bitmaps of the sets take.
    """
    spread = table.select(F.explode("tokens").alias("token"), "sid")
    shared = spread.groupBy("token").agg(F.min("sid").alias("sid"), F.max("sid").alias("tid"), F.count(F.lit(1)).alias("rows")).where("sid < tid")
    with planned_once(table.sparkSession):
        shared, of_shared = counted(shared, "shared-shingles", F.coalesce(F.sum(F.when(F.col("rows") > 2, F.col("rows"))), F.lit(0)).alias("more"), rows=tokens)
    more = shared.where("rows > 2").select("token")
    size = F.coalesce(F.sum(F.least(F.col("n") / 2, F.lit(MOST_BITS // 8))), F.lit(0)).cast("long").alias("bytes")
    postings, of_postings = counted(spread_where(table, token_filter(more)).join(more, "token").distinct(), "postings", size, rows=of_shared["more"])
    bits = sets.select("sid", "n", "bits")

    def links(share: Column) -> DataFrame:
        two = shared.where("rows = 2").where(share).select("sid", "tid").distinct()
        direct = two.join(bits, "sid").join(bits.toDF("tid", "m", "other"), "tid").select("sid", "n", "bits", "tid", "m", "other").mapInArrow(direct_pairs(rule), "u bigint, v bigint").toDF("a", "b")
        some = postings.where(share)
        per_token = some.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("sid").alias("a"))
        # By a struct, so that the table of counts is shuffled once more, alone, and Spark can split the postings of a hot token.
        told = some.join(per_token.withColumnRenamed("token", "of"), F.struct(F.col("token").alias("of")) == F.struct("of")).drop("of")
        ties = told.where((F.col("many") > limit) & (F.col("sid") != F.col("a"))).select("a", F.col("sid").alias("b"))
        by_size, n = Window.partitionBy("token").orderBy("n"), F.col("n")
        near = (F.lag("n").over(by_size) * rule.den >= n * rule.num) | (n * rule.den >= F.lead("n").over(by_size) * rule.num)
        sized = told.where(F.col("many") <= limit).withColumn("near", near).where("near").select("token", "sid", "n")
        small = sized.join(bits.drop("n"), "sid").select("token", "sid", "n", "bits")
        pairs = small.repartition("token").sortWithinPartitions("token").mapInArrow(candidate_pairs(rule), "u bigint, v bigint").toDF("a", "b")
        return pairs.unionAll(ties).unionAll(direct)

    rows, rounds = of_shared["rows"] + of_postings["rows"], max(1, math.ceil(of_postings["bytes"] / max(POSTING_BYTES, POSTING_TIMES * bytes_)))
    if rounds == 1:
        edges, _ = stars(links(F.lit(True)), rows=rows)
    else:
        found, of_found = in_rounds(rounds, ["token"], links, "pairs", rows=rows)
        edges, _ = stars(found, rows=of_found["rows"])
        dropped(found)
    dropped(shared, postings)
    return edges


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches as Python values, few at a time."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE).columns])


def direct_pairs(rule: Rule):
    """For mapInArrow over pairs of (sid, n, bits): those that may link, contracted to stars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return contracted(([(s, t)] for s, n, x, t, m, y in sliced(batches) if pair_may_link(n, x, m, y, rule)), pa.int64())

    return run


def candidate_pairs(rule: Rule):
    """For mapInArrow over (token, sid, n, bits) sorted by token: sids that may link, contracted to stars."""

    def pairs(sids: list[int], sizes: list[int], maps: list[bytes]) -> list[tuple[int, int]]:
        if len(sids) < 2:
            return []
        return [(sids[i], sids[j]) for i, j in pairs_by_width(sizes, [np.frombuffer(m, np.uint64) for m in maps], rule)]

    tested: set[tuple[int, int]] = set()

    def new_pairs(group: list[list]) -> list[tuple[int, int]]:
        sids, sizes, maps = group
        if len(sids) > FEW:
            return pairs(*group)
        out = []
        for i in range(len(sids)):
            for j in range(i):
                key = (sids[i], sids[j]) if sids[i] < sids[j] else (sids[j], sids[i])
                if key in tested:
                    continue
                if len(tested) >= TESTED:
                    tested.clear()
                tested.add(key)
                if pair_may_link(sizes[i], maps[i], sizes[j], maps[j], rule):
                    out.append(key)
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = (list(map(list, zip(*rows)))[1:] for _, rows in groupby(sliced(batches), key=lambda row: row[0]))
        return contracted((new_pairs(g) for g in groups if len(g[0]) > 1), pa.int64())

    return run


def pairs_by_width(sizes: list[int], maps: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Pairs of sets that may link, without those that connect nothing new.

    Bitmaps of one width make a tree. Trees are compared where sizes allow a link, the wider bitmaps folded for that only: a
    bitmap folded to the width of a far smaller set would be full, and would rule out nothing.
    """
    by_width: dict[int, list[int]] = {}
    for i, m in enumerate(maps):
        by_width.setdefault(len(m), []).append(i)

    def tree(members: list[int], words: int) -> SignatureTree:
        return SignatureTree(members, np.stack([folded(maps[i], words) for i in members]), np.array([sizes[i] for i in members]))

    out, every = [], list(range(len(sizes)))
    for words, members in sorted(by_width.items()):
        own = tree(members, words)
        out += traverse(own, own, rule, every, lambda i, j: True)
        most = max(sizes[i] for i in members)
        for wider in sorted(w for w in by_width if w > words):
            reach = [i for i in by_width[wider] if most * rule.den >= rule.num * sizes[i]]
            if reach:
                out += traverse(own, tree(reach, words), rule, every, lambda i, j: True)
    return out


def pair_may_link(n: int, x: bytes, m: int, y: bytes, rule: Rule) -> bool:
    """The bound of may_link for two sets of n and m elements."""
    if n * rule.den < rule.num * m or m * rule.den < rule.num * n:
        return False
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    wide, low = max(len(x), len(y)) * 8, min(len(x), len(y)) * 8
    while wide > low:
        wide //= 2
        mask = (1 << wide) - 1
        a, b = (a >> wide | a) & mask, (b >> wide | b) & mask
    most = (a & b).bit_count() + min(n - a.bit_count(), m - b.bit_count())
    return most * (rule.num + rule.den) >= rule.num * (n + m)


class SignatureTree:
    """Sets sorted by size under nodes of FAN_OUT children, level by level from the leaves."""

    def __init__(self, members: list[int], maps: np.ndarray, size: np.ndarray):
        order = np.lexsort((maps[:, 0], size))
        self.leaf = [members[i] for i in order]
        maps, size = maps[order], size[order].astype(np.int64)
        surplus = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, surplus)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, surplus = self.levels[-1]
            cut = np.arange(0, len(maps), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(surplus, cut)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FAN_OUT, min((node + 1) * FAN_OUT, len(self.levels[level - 1][0])))


def may_link(a: SignatureTree, la: int, xs: np.ndarray, b: SignatureTree, lb: int, ys: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs of nodes xs of a and ys of b may hold linked sets.

    Shared elements fall on shared bits; a set has `surplus` more elements than bits, so no two sets of the
    nodes share more than the bits common to both nodes and the smaller of their largest surpluses.
    """
    (ma, low_a, high_a, sa), (mb, low_b, high_b, sb) = a.levels[la], b.levels[lb]
    low_x, low_y = low_a[xs][:, None], low_b[ys][None, :]
    ok = (high_a[xs][:, None] * rule.den >= rule.num * low_y) & (high_b[ys][None, :] * rule.den >= rule.num * low_x)
    i, j = np.nonzero(ok)
    shared = np.bitwise_count(ma[xs[i]] & mb[ys[j]]).sum(axis=1, dtype=np.int64) + np.minimum(sa[xs[i]], sb[ys[j]])
    total = low_a[xs[i]] + low_b[ys[j]]
    ok[i, j] = shared * (rule.num + rule.den) >= rule.num * total
    return ok


def traverse(a: SignatureTree, b: SignatureTree, rule: Rule, groups: list[int], linked) -> list[tuple[int, int]]:
    """Pairs of leaves that may link and for which linked holds, without those that connect nothing new.

    a may be b: then each pair is looked at once. groups: leaves of one number are connected already.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    alone = a is b
    out: list[tuple[int, int]] = []
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, x, lb, y = stack.pop()
        if la == 0 and lb == 0:
            i, j = a.leaf[x], b.leaf[y]
            if i != j and root(groups[i]) != root(groups[j]) and linked(i, j):
                parent[root(groups[i])] = root(groups[j])
                out.append((i, j))
            continue
        # The higher of the two opens; a tree against itself opens on both sides at once.
        down_a = la >= lb and la > 0
        down_b = lb >= la and lb > 0
        xs = a.children(la, x) if down_a else np.array([x])
        ys = b.children(lb, y) if down_b else np.array([y])
        ok = may_link(a, la - down_a, xs, b, lb - down_b, ys, rule)
        if alone:
            ok &= xs[:, None] <= ys[None, :]
        stack += [(la - down_a, int(xs[i]), lb - down_b, int(ys[j])) for i, j in zip(*np.nonzero(ok))]
    return out


def tree_links(sets: list[np.ndarray], rule: Rule, groups: list[int] | None = None, left: list[int] | None = None, right: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all sets which are connected by linked pairs, without those that join nothing new.

    groups: sets of one number are known to be connected. With left and right only pairs across the two
    lists are looked at. Sets must not be empty.
    """
    groups = groups or list(range(len(sets)))
    if not sets or left is not None and not (left and right):
        return []
    bits = bits_for(2 * max(map(len, sets)))

    def tree(members: list[int]) -> SignatureTree:
        return SignatureTree(members, np.stack([bitmap(sets[i], bits) for i in members]), np.array([len(sets[i]) for i in members]))

    def linked(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both * rule.den >= rule.num * (len(sets[i]) + len(sets[j]) - both)

    if left is None:
        own = tree(list(range(len(sets))))
        return traverse(own, own, rule, groups, linked)
    return traverse(tree(left), tree(right), rule, groups, linked)


def by_group(rows: DataFrame, keys: list[str], columns: list[str], of_group, schema: str) -> DataFrame:
    """What of_group yields for each group of rows of equal keys, from an iterator over its rows (columns).

    Rows stream in sorted by key, so a group's rows are taken one by one as they come.
    """
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, group in groupby(sliced(batches), key=lambda row: row[:n]):
            held += of_group(key, (row[n:] for row in group))
            if len(held) > 10_000:
                yield made(held)
                held = []
        yield made(held)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    fields = [f.split(" ") for f in schema.split(", ")]
    names = [name for name, _ in fields]
    kinds = [{"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}[kind] for _, kind in fields]
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


TOLD = ["set", "comp", "side", "text"]


class Group:
    """The sets of one group. Texts are hashed as they come; one that isn't that of its set (identifiers may repeat) is left out."""

    def __init__(self, rows: Iterable[tuple], words: int):
        self.digests, self.sets, self.comps, self.sides, seen = [], [], [], [], set()
        for digest, comp, side, text in rows:
            h = shingles(text, words)
            if len(h) and (digest, side) not in seen and xxhash.xxh3_128_digest(h.tobytes()) == digest:
                seen.add((digest, side))
                self.digests.append(digest)
                self.sets.append(h)
                self.comps.append(comp)
                self.sides.append(side)


def local_roots(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """(set, root) for each set of a group (rows: keys and TOLD) that links reach from a smaller one in it: the smallest of these."""

    def of_group(key: tuple, group: Iterable[tuple]) -> list[tuple]:
        g, forest = Group(group, rule.words), Forest()
        for i, j in tree_links(g.sets, rule, g.comps) if len(g.sets) > 1 else []:
            forest.join(g.comps[i], g.comps[j])
        return forest.ends()

    return by_group(rows, keys, TOLD, of_group, "set binary, root binary")


def links_across(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """Links (a, b) of known components between the sets of side 1 and those of side 2 of each group, without those that connect nothing new."""

    def of_group(key: tuple, group: Iterable[tuple]) -> list[tuple]:
        g = Group(group, rule.words)
        left, right = [i for i, s in enumerate(g.sides) if s == 1], [i for i, s in enumerate(g.sides) if s == 2]
        return [(g.comps[i], g.comps[j]) for i, j in tree_links(g.sets, rule, g.comps, left, right)]

    return by_group(rows, keys, TOLD, of_group, "a binary, b binary")


def candidates_across(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """The keys of groups, with the sets of either side of which the bitmaps allow a link to a set of the other side and of another component."""

    def of_group(key: tuple, group: Iterable[tuple]) -> list[tuple]:
        sets, comps, sizes, maps, sides = map(list, zip(*group))
        left, right = [i for i, s in enumerate(sides) if s == 1], [i for i, s in enumerate(sides) if s == 2]
        if not left or not right:
            return []
        arrays = [np.frombuffer(m, np.uint64) for m in maps]
        words = min(map(len, arrays))
        tree = lambda members: SignatureTree(members, np.stack([folded(arrays[i], words) for i in members]), np.array([sizes[i] for i in members]))
        found: set[int] = set()

        def linked(i: int, j: int) -> bool:
            # Trees over the narrowest bitmaps allow more than the pair's own ones.
            if not (i in found and j in found) and pair_may_link(sizes[i], maps[i], sizes[j], maps[j], rule):
                found.update((i, j))
            return False

        traverse(tree(left), tree(right), rule, comps, linked)
        return [(*key, sets[i], sizes[i], sides[i]) for i in sorted(found)]

    return by_group(rows, keys, ["set", "comp", "n", "bits", "side"], of_group, "block bigint, band int, part int, rest_band int, rest_part int, set binary, n bigint, side int")


def similar(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    Words are runs outside the blanks 20 and 09-0D after lower-casing A-Z. Two texts link from the rule's
    similarity on; component_id is the smallest identifier that links reach, itself included. Texts without
    words (null, empty, blank) have no shingles and stay alone. Rows with a null identifier are counted but
    linked with nothing and have no component. Rows that repeat an identifier are each rated by their own
    text. Long texts are read whole; an empty table gives no rows; further columns aren't read.
    """
    return similar_sets(docs, rule, id_col, text_col, chunk).select("doc_id", "n_shingles", "component_id")


def similar_sets(docs: DataFrame, rule: Rule, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """similar() with the column `set`, the 128-bit hash of the row's shingles. `reads` of the result are the tables it is read from.

    Equal sets are one set from the start, and links are between sets. A block beyond `chunk` sets or
    CHUNK_SHINGLES shingles is dealt out by size class and hash: (1) components inside each chunk; (2) one set
    of each of these, dealt out again, which joins the parts of a large family; (3) what lies outside a
    block's largest component against the chunks of neighbouring size classes that the bitmaps leave. So no
    task holds more than about two chunks, and no link is lost.
    """
    with small_batches(docs.sparkSession):
        return _similar_sets(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), rule, chunk)


def _similar_sets(rows: DataFrame, rule: Rule, chunk: int) -> DataFrame:
    counts = sketch(rows.select("text"), rule)
    sums = [F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("tokens")]
    table, of_table = counted(signatures(rows, counts, rule, "doc", "text"), "signatures", *sums)
    named = table.where("doc is not null and n > 0")
    with planned_once(rows.sparkSession):
        bytes_ = F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bytes")
        sets, of_sets = counted(named.groupBy("set", "sid", "n").agg(F.min("doc").alias("doc"), F.first("bits").alias("bits")), "sets", bytes_, rows=of_table["rows"], per_file=10_000)
    edges = blocks(named, sets, rule, chunk, of_table["tokens"], of_sets["bytes"])
    block = with_roots(edges).select(F.col("node").alias("sid"), F.col("label").alias("block"))
    step = F.floor(F.ln("n") / F.lit(math.log(rule.den / rule.num))).cast("int")
    members = sets.join(block, "sid").select("set", "doc", "n", "bits", "block", step.alias("class"))
    per_class = members.groupBy("block", "class").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    of_block = per_class.groupBy("block").agg(((F.sum("sets") > chunk) | (F.sum("shingles") > CHUNK_SHINGLES)).alias("large"))
    dealt = per_class.join(of_block, "block").select("block", "class", "large", parts_for(F.col("sets"), F.col("shingles"), chunk).alias("parts"))
    part = F.when(F.col("large"), F.pmod(F.xxhash64("set"), F.col("parts"))).otherwise(0).cast("int")
    members = members.join(dealt, ["block", "class"]).withColumn("part", part).withColumn("band", F.when(F.col("large"), F.col("class")).otherwise(-1))
    sums = F.coalesce(F.sum((F.col("band") >= 0).cast("int")), F.lit(0)).alias("large")
    members, of_members = counted(members.select("set", "doc", "n", F.when(F.col("large"), F.col("bits")).alias("bits"), "block", "band", "part"), "members", sums, rows=of_sets["rows"], per_file=10_000)
    dropped(edges)
    tidy(rows.sparkSession)
    texts = rows.where("doc is not null")

    def told(parts: DataFrame, comp: str, keys: list[str], side: int = 0, rows: int = of_members["rows"]) -> DataFrame:
        return texts.join(broadcast_below(parts.select("doc", "set", F.col(comp).alias("comp"), *keys), rows), "doc").select(*keys, "set", "comp", F.lit(side).alias("side"), "text")

    keys = ["block", "band", "part"]
    with planned_once(rows.sparkSession):
        roots = written(local_roots(told(members, "set", keys), keys, rule), "roots", rows=of_members["rows"], per_file=CHUNK)
    labels, kept = with_roots(roots.toDF("u", "v")), [table, sets, roots]
    if of_members["large"]:
        large = members.where("band >= 0")
        small = written(roots.join(large.select("set"), "set", "left_anti"), "roots", rows=of_members["rows"])
        of_large = large_stars(large, roots, told, rule, chunk, of_members["large"])
        labels, kept = with_roots(small.toDF("u", "v").unionAll(of_large)), [table, sets, small, of_large]
        dropped(roots)
    first = sets.join(labels, sets["set"] == labels["node"]).groupBy("label").agg(F.min("doc").alias("component"))
    of_set = labels.join(first, "label").select("node", "component")
    of_set = sets.join(of_set, sets["set"] == of_set["node"], "left").select("set", F.coalesce("component", "doc").alias("component"))
    placed = few(table.join(of_set, "set", "left"), of_table["rows"])
    own = F.when(F.col("n") == 0, F.col("doc")).when(F.col("doc").isNotNull(), F.col("component"))
    out = placed.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), "set")
    dropped(members)
    out.reads = kept
    return out


def parts_for(sets: Column, shingles_: Column, chunk: int) -> Column:
    """How many chunks so many sets with so many shingles in all call for."""
    return F.greatest(F.ceil(sets / chunk), F.ceil(shingles_ / CHUNK_SHINGLES)).cast("int")


def large_stars(large: DataFrame, roots: DataFrame, told, rule: Rule, chunk: int, rows: int) -> DataFrame:
    """(u, v) of the components of large blocks: steps 2 and 3 of similar_sets, after the roots of step 1."""

    def relabelled(table: DataFrame, old: str, new: DataFrame) -> DataFrame:
        """Column old becomes its root in new (set, root), where it has one."""
        return table.join(new.toDF("__set", "__root"), F.col(old) == F.col("__set"), "left").withColumn(old, F.coalesce("__root", old)).drop("__set", "__root")

    first = relabelled(large.withColumn("comp", F.col("set")), "comp", roots)
    heads = first.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("block").alias("of_block"), "comp")
    heads = large.join(heads, (F.col("block") == F.col("of_block")) & (F.col("set") == F.col("comp"))).select("block", "doc", "set", "n", "comp")
    spread = heads.groupBy("block").agg(parts_for(F.count(F.lit(1)), F.sum("n"), chunk).alias("parts"))
    heads = heads.join(spread, "block").select("block", "doc", "set", "comp", F.pmod(F.xxhash64("set"), "parts").cast("int").alias("part"))
    heads, of_heads = counted(heads, "heads", rows=rows)
    with planned_once(large.sparkSession):
        joined = written(local_roots(told(heads, "comp", ["block", "part"], rows=of_heads["rows"]), ["block", "part"], rule), "roots", rows=of_heads["rows"], per_file=CHUNK)

    bytes_ = F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bytes")
    now, of_now = counted(relabelled(first, "comp", joined), "large", bytes_, rows=rows, per_file=10_000)
    by_component = now.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = by_component.groupBy("block").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"))
    rest = now.join(main, "block").where("comp <> main").drop("main")
    rest_parts = rest.groupBy("block", "band").agg(parts_for(F.count(F.lit(1)), F.sum("n"), chunk).alias("parts"))
    rest = rest.join(rest_parts, ["block", "band"]).withColumn("rest_part", F.pmod(F.xxhash64("set"), "parts").cast("int"))
    rest, of_rest = counted(rest.select("block", "doc", "set", "n", "bits", "comp", F.col("band").alias("rest_band"), "rest_part"), "rest", rows=rows, per_file=10_000)
    before = now
    links, of_links = links_of_rest(now, rest, told, rule, chunk, rows, of_now["bytes"]) if of_rest["rows"] else (None, {"rows": 0})
    if of_links["rows"]:
        linked, _ = stars(links, rows=of_links["rows"])
        now = relabelled(now, "comp", linked.select("u", "v"))
    done = written(now.where("comp <> set").select(F.col("set").alias("u"), F.col("comp").alias("v")), "stars", rows=rows)
    dropped(heads, joined, before, rest)
    tidy(large.sparkSession)
    return done


def links_of_rest(now: DataFrame, rest: DataFrame, told, rule: Rule, chunk: int, rows: int, bytes_: int) -> tuple[DataFrame, dict]:
    """Links (a, b) between components: step 3 of similar_sets. bytes_: what the bitmaps of now take.

    A chunk goes to as many groups as there are chunks of neighbouring size, so groups are dealt out over rounds, and the disk
    holds one round. Texts follow of those sets only that the bitmaps leave, in rounds too.
    """
    here = now.groupBy("block", "band", "part").agg(F.sum(F.octet_length("bits")).alias("left_bytes"))
    there = rest.groupBy("block", "rest_band", "rest_part").agg(F.sum(F.octet_length("bits")).alias("right_bytes"))
    # Sets that link lie at most one class apart, two with what rounding may add.
    both = F.coalesce(F.sum(F.col("left_bytes") + F.col("right_bytes")), F.lit(0)).alias("bytes")
    tasks, of_tasks = counted(here.join(there, "block").where("abs(band - rest_band) <= 2"), "tasks", both, rows=rows)
    keys, seen = ["block", "band", "part", "rest_band", "rest_part"], ["set", "comp", "n", "bits"]

    def candidates(share: Column) -> DataFrame:
        some = tasks.where(share).select(*keys)
        left = now.join(some, ["block", "band", "part"]).select(*keys, *seen, F.lit(1).alias("side"))
        right = rest.join(some, ["block", "rest_band", "rest_part"]).select(*keys, *seen, F.lit(2).alias("side"))
        return candidates_across(left.unionAll(right), keys, rule)

    rounds = max(1, math.ceil(of_tasks["bytes"] / max(ROUND_BYTES, 4 * bytes_)))
    found, of_found = in_rounds(rounds, keys, candidates, "candidates", F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), rows=of_tasks["rows"], per_file=8)
    if not of_found["rows"]:
        return found, of_found

    def links(share: Column) -> DataFrame:
        some = found.where(share).drop("n")
        left = now.join(some.where("side = 1"), ["block", "band", "part", "set"]).select("doc", "set", "comp", *keys)
        right = rest.join(some.where("side = 2"), ["block", "rest_band", "rest_part", "set"]).select("doc", "set", "comp", *keys)
        return links_across(told(left, "comp", keys, 1, of_found["rows"]).unionAll(told(right, "comp", keys, 2, of_found["rows"])), keys, rule)

    out = in_rounds(max(1, math.ceil(of_found["shingles"] / ROUND_SHINGLES)), keys, links, "links", rows=of_found["rows"], per_file=chunk)
    dropped(tasks, found)
    return out


def without_near_copies(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs but those whose text links to one with a smaller identifier, directly or through others.

    Null, empty and blank texts link to nothing and stay, as do rows with a null identifier. Rows that repeat an
    identifier are each rated by their own text; equal ones of one identifier are one document, and stay or
    go together. An empty table stays empty; long texts are read whole; further columns pass through whatever their names.
    """
    lost_id, lost_sets = free_names(docs.columns, "lost", "lost_sets")
    found = similar_sets(docs, rule, id_col, text_col)
    reads, found = found.reads, found.where("doc_id is not null")
    lost = F.col("component_id") < F.col("doc_id")
    per_id = found.groupBy("doc_id").agg(F.min(lost).alias("all_lost"), F.collect_set(F.when(lost, F.col("set"))).alias("sets")).where(F.size("sets") > 0)
    per_id = per_id.select(F.col("doc_id").alias(lost_id), "all_lost", F.when(~F.col("all_lost"), F.col("sets")).alias("sets"))
    per_id, seen = counted(per_id, "near-copies", F.coalesce(F.sum((~F.col("all_lost")).cast("int")), F.lit(0)).alias("mixed"))
    dropped(*reads)
    kept = docs.join(per_id.select(lost_id), docs[id_col] == F.col(lost_id), "left_anti")
    if not seen["mixed"]:
        return kept
    # Of these identifiers some rows go and others stay, so their texts are looked at again.
    mixed = docs.join(per_id.where("not all_lost").select(lost_id, F.col("sets").alias(lost_sets)), docs[id_col] == F.col(lost_id))
    at, sets_at, width = docs.columns.index(text_col), len(docs.columns) + 1, len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(shingles(v.as_py(), rule.words).tobytes()) for v in batch.column(at)]
            stay = pa.array([d not in s for d, s in zip(digests, batch.column(sets_at).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(stay) for c in batch.columns[:width]], schema=pa.schema(list(batch.schema)[:width]))

    return kept.unionAll(mixed.mapInArrow(run, docs.schema))
