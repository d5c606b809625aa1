"""Merging of streams in time without a change of order inside any of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktstream.functions.scalar import unsigned_order
from mktstream.operators.running import running_max


def merge_keys(stream: DataFrame, number: int, index_ts: str, position: str, hint: int | None = None, is_sorted: bool = False) -> DataFrame:
    """stream with __stream, __position and __key: the largest time so far, which is when a merge lets a record out.

    A hint is the time from which the merge may open the stream. Of a stream known to be sorted the record's own
    time is the key, without a window; otherwise the maximum runs inside ranges of the position, and one row a
    range carries it on (operators.running).
    """
    own = unsigned_order(index_ts)
    if hint is not None:
        own = F.greatest(own, unsigned_order(F.lit(hint)))
    keyed = stream.withColumn("__key", own) if is_sorted else running_max(stream, "__key", own, position)
    return keyed.withColumn("__stream", F.lit(number)).withColumn("__position", F.col(position))


def merge_streams(streams: list[DataFrame], index_ts: str, position: str, hints: list[int | None] | None = None, is_sorted: list[bool] | None = None, ordered: bool = True) -> DataFrame:
    """The records of all streams in merge order: by time, ties by stream, inside a stream as they came.

    Columns that only some streams have are null in the others. The order is a range-partitioned sort, one
    exchange; ordered=False leaves __key, __stream and __position to sort by.
    """
    if not streams:
        raise ValueError("nothing to merge")
    parts = [merge_keys(s, i, index_ts, position, hints[i] if hints else None, bool(is_sorted and is_sorted[i])) for i, s in enumerate(streams)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.orderBy("__key", "__stream", "__position") if ordered else whole
