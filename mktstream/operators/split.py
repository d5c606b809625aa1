"""Keys that split a stream into files, and the writing of the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.functions.scalar import index_date, schema_of_rtype
from mktstream.functions.values import RTYPE_SCHEMA


def time_key(index_ts: str, unit: str) -> Column:
    """First day of the UTC day, week (from Sunday) or month; an undefined time is an error."""
    day = F.coalesce(index_date(index_ts), F.raise_error(F.lit("a record has no time")).cast("date"))
    if unit == "day":
        return day
    if unit == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if unit == "month":
        return F.trunc(day, "MM").cast("date")
    raise ValueError(unit)


def key_end(key: Column, unit: str) -> Column:
    """The first day after the part."""
    return F.add_months(key, 1) if unit == "month" else F.date_add(key, 7 if unit == "week" else 1)


def split_by_time(records: DataFrame, index_ts: str, unit: str) -> DataFrame:
    return records.withColumn("split", F.date_format(time_key(index_ts, unit), "yyyy-MM-dd"))


def split_by_symbol(records: DataFrame) -> DataFrame:
    """By the column symbol; a record without one is an error."""
    return records.withColumn("split", F.coalesce("symbol", F.raise_error(F.concat(F.lit("no symbol for instrument "), F.col("instrument_id").cast("string")))))


def split_by_schema(records: DataFrame, no_schema: str = "error", position: str | None = None) -> DataFrame:
    """By the schema of the record type. Records of none: `skip`, `error`, or `broadcast` to parts already begun.

    A part has begun where a record of its schema stands earlier in the stream, so a control record is
    copied to each schema whose first position lies before its own. There are at most twenty schemas: their
    first positions are a small aggregate.
    """
    schema = schema_of_rtype("rtype")
    if no_schema == "skip":
        return records.withColumn("split", schema).where(F.col("split").isNotNull())
    if no_schema == "error":
        return records.withColumn("split", F.coalesce(schema, F.raise_error(F.concat(F.lit("no schema for record type "), F.col("rtype").cast("string")))))
    if no_schema != "broadcast" or position is None:
        raise ValueError("broadcast needs the position in the stream")
    own = records.withColumn("split", schema)
    begun = own.where(F.col("split").isNotNull()).groupBy("split").agg(F.min(position).alias("__begun"))
    control = records.where(~F.col("rtype").isin(*RTYPE_SCHEMA))
    copies = control.join(F.broadcast(begun.limit(len(RTYPE_SCHEMA))), F.col(position) > F.col("__begun")).drop("__begun")
    return own.where(F.col("split").isNotNull()).unionByName(copies)


def write_split(split: DataFrame, path: str, order: list[str], fmt: str = "parquet", **options) -> None:
    """One folder for each key. Rows are dealt out by key and range of the order, so a large key has several
    tasks, and each task writes its keys one after the other."""
    split.repartitionByRange("split", *order).sortWithinPartitions("split", *order).write.partitionBy("split").mode("errorifexists").format(fmt).options(**options).save(path)
