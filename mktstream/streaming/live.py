"""Live symbols kept as streaming state, and transcoding of a stream to text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from mktstream.operators.filters import of_kind, typed
from mktstream.operators.symbology import live_update, symbols_of
from mktstream.sources.binary import version_out
from mktstream.sources.codec import Records
from mktstream.sources.layouts import KIND, rtype_of, schema_layout
from mktstream.sources.text import csv_line, header, mixed_json


class LiveSymbols(StatefulProcessor):
    """The newest symbol of an instrument: rows are taken by position, an update holds from its own row on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.symbol = handle.getValueState("symbol", "symbol string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.symbol.get() if self.symbol.exists() else None
        before = state[0] if state else None
        batch = pd.concat(list(rows)).sort_values("position", kind="stable")
        batch["symbol"] = batch["update"].ffill().fillna(before) if before is not None else batch["update"].ffill()
        last = batch["symbol"].iloc[-1]
        if last is not None and not pd.isna(last):
            self.symbol.update((last,))
        yield batch.drop(columns="update")

    def close(self) -> None:
        pass


def with_live_symbol(records: DataFrame) -> DataFrame:
    """A stream with instrument_id, position and update (a new symbol or null), plus `symbol`, update replaced."""
    out = StructType([f for f in records.schema if f.name != "update"]).add("symbol", "string")
    return records.groupBy("instrument_id").transformWithStateInPandas(LiveSymbols(), outputStructType=out, outputMode="append", timeMode="none")


def transcode(spark: SparkSession, source: str, path: str, checkpoint: str, encoding: str = "csv", schema: str | None = None, intervals: DataFrame | None = None, map_symbols: bool = True, on_mismatch: str = "skip", sep: str = ",", pretty_px: bool = True, pretty_ts: bool = True, **options: str) -> StreamingQuery:
    """The records of a growing file as CSV or JSON lines in the folder path, from where the checkpoint left off.

    Symbols come from intervals (a table) or the file's metadata if these name a schema, else from the stream's own
    symbol mappings, which hold from their record on. CSV has records of one schema, that of the metadata if none is given; others
    are left out, or with on_mismatch=error fail the query. JSON has all records. The header of CSV is the file
    `_header` in path, as each batch adds files of its own. options: of the source.
    """
    options = {"upgrade_policy": "upgrade_to_v3"} | options
    with open(source.removeprefix("file://"), "rb") as f:
        meta = Records(f, options).meta
    schema = schema or (meta.schema if meta else None)
    if encoding == "csv" and schema is None:
        raise ValueError("CSV of a stream of several schemas needs a schema")
    version, ts_out = version_out(options | {"path": source})
    rows = spark.readStream.format("mktbin").options(**options, schema="mixed", position="true").load(source)
    if map_symbols:
        if meta is not None and meta.schema is None:
            update = live_update()
            rows = with_live_symbol(rows.withColumn("update", update))
        else:
            rows = symbols_of(rows, meta, "index_ts", "position", intervals)
    if encoding == "csv":
        name = schema_layout(schema, version)
        rows = typed(rows, rtype_of(schema), on_mismatch == "error")
        line = csv_line(name, sep, pretty_px, pretty_ts, ts_out, map_symbols)
        kept = of_kind(rows, KIND[rtype_of(schema)])
        write_header(spark, path, header(name, ts_out, map_symbols, sep))
    else:
        kept, line = rows, mixed_json(version, pretty_px, pretty_ts, ts_out, map_symbols)
    return kept.select(line.alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_header(spark: SparkSession, path: str, line: str) -> None:
    """The header as the file _header, through Spark's file system; readers of the folder pass over it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_header")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray((line + "\n").encode()))
    out.close()
