"""The tables at hand as record streams.

Trades come from lineitem, order-book events from events, status records from orders, and symbol intervals
from part. Rows get their place in the stream from a key that is unique in each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mktstream.sources.layouts import KIND

TRADE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str) -> Column:
    """Nanoseconds since 1970 of a time without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)") * 1000


def price(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long") * 10_000_000


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        ns("l_shipdate").alias("ts_recv"), F.lit(0).cast("short").alias("rtype"), (F.col("l_linenumber") % 107 + 1).cast("int").alias("publisher_id"),
        F.col("l_partkey").alias("instrument_id"), F.substring(F.col("l_returnflag"), 1, 1).alias("side"), price("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("long").alias("size"), *TRADE_KEY,
    )


#: Record kind by record type.
RTYPE_OF = KIND
#: Record type of each event type.
EVENT_RTYPE = {"click": 0xA0, "view": 0x01, "purchase": 0x00, "signup": 0x16, "error": 0x15}


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mktstream.functions.scalar import lookup

    return table(spark, sf_dir, "events").select(
        ns("ts").alias("ts_recv"), lookup("event_type", EVENT_RTYPE).cast("short").alias("rtype"), F.col("user_id").alias("instrument_id"), price("value").alias("price"),
        "event_id", (F.col("event_id") % 256).cast("short").alias("flags"), "event_type",
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(ns("o_orderdate").alias("ts_recv"), F.lit(0x12).cast("short").alias("rtype"), F.col("o_custkey").alias("instrument_id"), "o_orderkey")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two intervals for each part, the second from 1997-01-01; every tenth part has a third that overlaps both."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instrument_id"), "p_brand")
    span = lambda a, b, tag, i: F.struct(F.lit(a).cast("date").alias("start_date"), F.lit(b).cast("date").alias("end_date"), F.concat("p_brand", F.lit(tag)).alias("symbol"), F.lit(i).alias("ordinal"))
    usual = F.array(span("1995-01-01", "1997-01-01", ".A", 0), span("1997-01-01", "1999-01-01", ".B", 1))
    more = F.concat(usual, F.array(span("1996-06-01", "1997-06-01", ".C", 2)))
    return part.select("instrument_id", F.explode(F.when(F.col("instrument_id") % 10 == 0, more).otherwise(usual)).alias("s")).select("instrument_id", "s.*")
