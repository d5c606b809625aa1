"""Fixed-size count vectors gathered from all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mktstream.llm.common import planned_once

MERGERS = 8


def summed(df: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None], add=np.add) -> np.ndarray:
    """The sum (or what add makes of two) over all rows of df of a vector of size counters, which count changes batch by batch.

    Each task sends one vector. MERGERS tasks add these up as they stream in, whatever their number, one
    task adds up theirs, and the driver gets one vector, packed: its share depends on size alone.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            count(batch, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for v in batch.column(0):
                add(total, np.frombuffer(v.as_buffer(), dtype=np.int64), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(v.as_buffer(), 1) for v in batch.column(0)], pa.binary())], ["v"])

    with planned_once(df.sparkSession):
        parts = df.mapInArrow(partial, "v binary").repartition(MERGERS).mapInArrow(merged, "v binary")
        whole = parts.repartition(1).mapInArrow(packed, "v binary").collect()
    return np.frombuffer(zlib.decompress(whole[0].v), dtype=np.int64)
