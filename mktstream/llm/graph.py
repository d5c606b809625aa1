"""Connected components of a graph kept as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktstream.llm.common import broadcast_below, counted, dropped, is_small, planned_once, tidy, written

MAX_ROUNDS = 60
#: A task contracts about so many nodes at once.
HELD_NODES = 100_000
#: Links come from tasks with work of their own, so a file of theirs has fewer rows than others.
LINKS_PER_FILE = 20_000


class Forest:
    """Union and find over any values; a root is the smallest of its tree."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = (a, b) if a < b else (b, a)
            self.parent[b] = a

    def ends(self) -> list[tuple]:
        """(node, root) for each node that isn't a root."""
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def contracted(links: Iterable[list[tuple]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: links, list by list, as fewer ones (u, v) that connect the same nodes: stars of what is held at a time."""
    forest = Forest()

    def made() -> pa.RecordBatch:
        ends = forest.ends()
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in ends], kind) for k in (0, 1)], ["u", "v"])

    for some in links:
        for a, b in some:
            forest.join(a, b)
        if len(forest.parent) >= HELD_NODES:
            yield made()
            forest = Forest()
    yield made()


def _smallest(edges: DataFrame, at: str, rows: int) -> DataFrame:
    """edges, at most so many, and `m`, the smallest v of the node in column `at`, null if that is no u.

    The smallest is found by an aggregation that combines before the shuffle. It is broadcast if so many rows stay below the
    bound, else joined by the node as a struct: so its table is shuffled once more, alone, and Spark can split the other
    side where a node has very many edges.
    """
    least = broadcast_below(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), rows)
    return edges.join(least, F.struct(F.col(at).alias("x")) == F.struct("x"), "left").drop("x")


def _large(edges: DataFrame, rows: int) -> DataFrame:
    """Every node's larger neighbours tied to its smallest one, or to itself if it has none."""
    return _smallest(edges, "v", rows).select("u", F.coalesce("m", "v").alias("v"))


def _small(edges: DataFrame, rows: int) -> DataFrame:
    """Every node's smaller neighbours, and itself, tied to its smallest one."""
    known = _smallest(edges, "u", rows)
    ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return known.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def stars(links: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """(u, v): each node of the links (columns a and b) but the smallest of its component, and that one; and their number.

    Large and small stars alternate until the edges no longer change. Each is written to the shared folder in
    one job, which also takes the sums that tell whether the round changed anything. Links with a null end and
    links of a node to itself are left out. rows: a bound of the number of links.
    """
    spark = links.sparkSession
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sums")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, now = counted(edges, "edges", sums, rows=rows, per_file=LINKS_PER_FILE)
    for _ in range(MAX_ROUNDS):
        if not now["rows"]:
            return edges, 0
        with planned_once(spark) if is_small(now["rows"], 2) else nullcontext():
            between = written(_large(edges, now["rows"]), "edges", rows=now["rows"])
            after, then = counted(_small(between, now["rows"]), "edges", sums, rows=now["rows"])
        dropped(edges, between)
        if then == now:
            tidy(spark)
            return after, then["rows"]
        edges, now = after, then
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def with_roots(edges: DataFrame) -> DataFrame:
    """(node, label) of stars(), with each root under its own label."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (columns a and b); label is the smallest node it can reach."""
    return with_roots(stars(links)[0])
