"""Symbols of instruments: by time, at one date, and live."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mktstream.functions.scalar import index_date
from mktstream.operators.running import running_last
from mktstream.plans.metadata import Metadata, interval_frame


def resolved_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals without overlap: where those of an instrument overlap, the one with the largest ordinal holds.

    The bounds of an instrument's intervals part its time into pieces; each piece takes the last interval
    that covers it. Empty intervals are ignored, and one that ends before it starts is an error. An instrument's intervals meet
    in one row (there are few, at most one a day), so there is one shuffle and no join; the intervals are a small table beside the records.
    """
    checked = intervals.where(F.when(F.col("start_date") > F.col("end_date"), F.raise_error(F.lit("an interval ends before it starts")).cast("boolean")).otherwise(F.col("start_date") < F.col("end_date")))
    spans = checked.groupBy("instrument_id").agg(F.collect_list(F.struct("start_date", "end_date", "ordinal", "symbol")).alias("spans"))
    bounds = F.array_sort(F.array_distinct(F.concat(F.transform("spans", lambda s: s["start_date"]), F.transform("spans", lambda s: s["end_date"]))))
    pieces = spans.withColumn("bounds", bounds).select("instrument_id", "spans", "bounds", F.posexplode("bounds").alias("at", "piece_start"))
    pieces = pieces.withColumn("piece_end", F.get("bounds", F.col("at") + 1)).where(F.col("piece_end").isNotNull())
    cover = F.filter("spans", lambda s: (s["start_date"] <= F.col("piece_start")) & (s["end_date"] >= F.col("piece_end")))
    held = pieces.withColumn("last", F.array_max(F.transform(cover, lambda s: F.struct(s["ordinal"].alias("ordinal"), s["symbol"].alias("symbol")))))
    return held.where(F.col("last").isNotNull()).select("instrument_id", F.col("piece_start").alias("start_date"), F.col("piece_end").alias("end_date"), "last.symbol")


def with_symbol(records: DataFrame, intervals: DataFrame, index_ts: str, resolved: bool = False) -> DataFrame:
    """records and `symbol`, that of the record's instrument on the UTC date of its time; null if none holds.

    Intervals are half open. Spark broadcasts them below its threshold; beyond it both sides are shuffled by
    instrument, and a hot instrument is split, as its intervals are few.
    """
    spans = (intervals if resolved else resolved_intervals(intervals)).select(F.col("instrument_id").alias("__id"), "start_date", "end_date", "symbol")
    day = index_date(index_ts)
    hold = (F.col("instrument_id") == F.col("__id")) & (day >= F.col("start_date")) & (day < F.col("end_date"))
    return records.drop("symbol").join(spans, hold, "left").drop("__id", "start_date", "end_date")


def intervals_at(intervals: DataFrame, day: Column) -> DataFrame:
    """(instrument_id, symbol) of the first interval of each mapping that covers the day; none if that has no symbol.

    intervals: mapping (any key of one mapping), instrument_id, start_date, end_date, symbol, ordinal.
    """
    cover = intervals.where((F.col("start_date") <= day) & (day < F.col("end_date")))
    first = cover.groupBy("mapping").agg(F.min_by(F.struct("instrument_id", "symbol"), "ordinal").alias("f"))
    return first.where("f.symbol <> ''").select("f.instrument_id", "f.symbol")


def with_symbol_at(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """records and `symbol` by instrument alone, as symbols (instrument_id, symbol) has it."""
    return records.drop("symbol").join(symbols, "instrument_id", "left")


def with_symbol_checked(records: DataFrame) -> DataFrame:
    """records, or an error at the first without a symbol."""
    return records.withColumn("symbol", F.coalesce("symbol", F.raise_error(F.concat(F.lit("no symbol for instrument "), F.col("instrument_id").cast("string")))))


def with_live_symbol(records: DataFrame, position: str, update: Column) -> DataFrame:
    """records and `symbol`, the last update of the instrument up to and with the record, in arrival order.

    update: the new symbol where a record is a symbol mapping (or a definition, if the caller wants these),
    else null: see live_update. The order is cut in ranges of the position, so no instrument, however hot, is one task's.
    """
    return running_last(records.drop("symbol"), "symbol", update, position, ["instrument_id"])


def live_update(definitions: bool = False) -> Column:
    """For with_live_symbol over a table of mixed types: what symbol mappings, and if asked for definitions, say of their instrument."""
    mapped = F.col("symbol_mapping.stype_out_symbol")
    return F.coalesce(mapped, F.col("definition.raw_symbol")) if definitions else mapped


def interval_map(spark: SparkSession, intervals: dict[int, list[tuple[date, date, str]]]) -> DataFrame:
    """An explicit map of instruments to (start, end, symbol) as a table of intervals; empty symbols are left out."""
    rows = [(number, a, b, s) for number, spans in intervals.items() for a, b, s in spans if s]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "instrument_id bigint, start_date date, end_date date, symbol string, ordinal int")


def oriented(mappings: DataFrame, inverse: bool) -> DataFrame:
    """Mapping intervals (raw_symbol, start_date, end_date, mapped, ordinal) as instrument_id and symbol, whichever side the ids are on.

    Intervals mapped to nothing are left out; an id that is no number of 32 bits is an error.
    """
    number, name = ("raw_symbol", "mapped") if inverse else ("mapped", "raw_symbol")
    known = mappings.where(F.coalesce(F.col("mapped"), F.lit("")) != "")
    value = F.expr(f"try_cast(`{number}` AS bigint)")
    checked = F.when(value.between(0, 0xFFFFFFFF), value).otherwise(F.raise_error(F.concat(F.lit("no instrument: "), F.col(number))).cast("bigint"))
    return known.select(checked.alias("instrument_id"), "start_date", "end_date", F.col(name).alias("symbol"), "ordinal")


def symbols_of(records: DataFrame, meta: Metadata | None, index_ts: str, position: str, explicit: DataFrame | None = None, definitions: bool = False) -> DataFrame:
    """records of mixed types, or of one, and `symbol` as their stream calls for.

    An explicit table of intervals holds before all else; metadata with a schema are of a historical stream, whose
    intervals hold; metadata without one are of a live stream, whose own records tell symbols as they come.
    """
    if meta is not None and meta.schema is None:
        return with_live_symbol(records, position, live_update(definitions))
    if explicit is not None:
        return with_symbol(records, explicit, index_ts)
    if meta is None:
        return records.drop("symbol").withColumn("symbol", F.lit(None).cast("string"))
    return with_symbol(records, interval_frame(records.sparkSession, meta), index_ts)
