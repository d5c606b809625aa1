"""Registered queries that write record files and text, read them back, and compare nothing: their SQL says what must come out."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktstream.functions import scalar as S
from mktstream.functions import values as V
from mktstream.operators import filters, split, symbology
from mktstream.operators.merge import merge_streams
from mktstream.operators.running import numbered
from mktstream.plans import streams as R
from mktstream.plans.metadata import Metadata, interval_frame
from mktstream.plans.upgrade import TEXTS
from mktstream.sources.binary import register
from mktstream.sources.layouts import HEADER, layout_name, mixed_schema, spark_schema
from mktstream.sources.store import read_records
from mktstream.sources.text import csv_lines, header, json_lines, mixed_json

PRICE = "CAST(round(value * 100) AS BIGINT) * 10000000"
TS = "epoch_us(ts) * 1000"


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir), for files that only one query reads.

    It has to be a mounted folder. Where the setting is unset a temporary folder is made, which only a local master may use.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="mktstream-")
    return f"{re.sub('^file:/+', '/', known).rstrip('/')}/files-{uuid.uuid4().hex}"


def with_layout(rows: DataFrame, layout: str, **values) -> DataFrame:
    """rows as records of a layout: the given columns, else columns of rows by their names, else zero or empty."""
    out = []
    for f in spark_schema(layout):
        value = values.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit("" if f.dataType.simpleString() == "string" else 0))
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def book(spark: SparkSession, d: str) -> DataFrame:
    """Events as order-book records: order_id is the event, sequence its low 32 bits."""
    e = R.book_events(spark, d)
    return with_layout(
        e.drop("rtype"), "mbo", ts_event=F.col("ts_recv") - 1000, rtype=F.lit(0xA0), publisher_id=F.lit(1), order_id=F.col("event_id"), size=F.col("event_id") % 1000,
        action=F.when(F.col("event_type") == "click", "A").otherwise("T"), side=F.lit("N"), ts_in_delta=-F.col("event_id") % 500, sequence=F.col("event_id"),
    )


def written(spark: SparkSession, rows: DataFrame, schema: str, order: str, **options) -> str:
    """The path of a record file with the rows in order."""
    register(spark)
    path = scratch(spark)
    rows.orderBy(order).write.format("mktbin").mode("append").options(schema=schema, dataset="XNAS.ITCH", start="0", **options).save(path)
    return path


def loaded(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.format("mktbin").options(schema=schema, **options).load(path)


def held(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows from a table in the shared folder, for plans that go over them several times: the source gives all columns and decodes anew each time."""
    path = scratch(spark)
    rows.write.parquet(path)
    return spark.read.parquet(path)


BOOK_SQL = f"""SELECT event_id AS order_id, {TS} AS ts_recv, {TS} - 1000 AS ts_event, user_id AS instrument_id, {PRICE} AS price, event_id % 1000 AS size,
  CAST(event_id % 256 AS SMALLINT) AS flags, CASE event_type WHEN 'click' THEN 'A' ELSE 'T' END AS action, CAST(-(event_id % 500) AS INTEGER) AS ts_in_delta FROM events"""
BOOK = ["order_id", "ts_recv", "ts_event", "instrument_id", "price", "size", "flags", "action", "ts_in_delta"]


def binary_query(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        reading = {k.removeprefix("read_"): v for k, v in options.items() if k.startswith("read_")}
        path = written(spark, book(spark, d), "mbo", "order_id", **{k: v for k, v in options.items() if not k.startswith("read_")})
        return loaded(spark, path, "mbo", **reading).select(*BOOK)

    return run


def binary_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of a file comes back by the positions of its records, read in slices."""
    path = written(spark, book(spark, d), "mbo", "order_id")
    rows = loaded(spark, path, "mbo", position="true", uniform="true", slice_bytes="100000")
    return numbered(rows, "pos", ["position"]).select("pos", "order_id")


def binary_store(spark: SparkSession, d: str) -> DataFrame:
    """A file read as from a store that only Spark reaches."""
    path = written(spark, book(spark, d), "mbo", "order_id", compression="zstd")
    return read_records(spark, f"file://{path}", schema="mbo").select(*BOOK)


def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    """Book records as CSV lines, written with their header and read back by Spark's own reader."""
    path = scratch(spark)
    rows = book(spark, d)
    head = spark.createDataFrame([(header("mbo", symbol=True),)], "value string").coalesce(1)
    head.write.text(f"{path}/head")
    csv_lines(rows.withColumn("symbol", F.concat(F.lit('a,"'), F.col("instrument_id").cast("string"))), "mbo", pretty_px=True, symbol=True).write.text(f"{path}/rows")
    names = spark.read.text(f"{path}/head").first().value.split(",")
    back = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("escape", '"').csv(f"{path}/rows")
    return back.select("order_id", "ts_recv", "price", "action", "size", "symbol")


CSV_SINK = f"""SELECT CAST(event_id AS VARCHAR) AS order_id, CAST({TS} AS VARCHAR) AS ts_recv,
  CAST(CAST({PRICE} AS DECIMAL(38,0)) * CAST(0.000000001 AS DECIMAL(10,9)) AS DECIMAL(29,9))::VARCHAR AS price,
  CASE event_type WHEN 'click' THEN 'A' ELSE 'T' END AS action, CAST(event_id % 1000 AS VARCHAR) AS size, 'a,"' || user_id AS symbol FROM events"""


def json_sink(spark: SparkSession, d: str) -> DataFrame:
    """Book records as JSON lines, written and parsed again."""
    path = scratch(spark)
    json_lines(book(spark, d), "mbo", pretty_px=True, pretty_ts_=True).write.text(path)
    inside = "ts_recv string, hd struct<ts_event: string, rtype: int, instrument_id: bigint>, action string, price string, size bigint, order_id string, flags int"
    v = spark.read.text(path).select(F.from_json("value", inside).alias("v"))
    return v.select("v.order_id", "v.ts_recv", F.col("v.hd.ts_event").alias("ts_event"), F.col("v.hd.instrument_id").alias("instrument_id"), "v.action", "v.price", "v.size", "v.flags")


JSON_SINK = f"""SELECT CAST(event_id AS VARCHAR) AS order_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(({TS}) % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS ts_recv,
  strftime(ts - INTERVAL 1 MICROSECOND, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(({TS} - 1000) % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS ts_event, user_id AS instrument_id,
  CASE event_type WHEN 'click' THEN 'A' ELSE 'T' END AS action,
  CAST(CAST({PRICE} AS DECIMAL(38,0)) * CAST(0.000000001 AS DECIMAL(10,9)) AS DECIMAL(29,9))::VARCHAR AS price, event_id % 1000 AS size, CAST(event_id % 256 AS INTEGER) AS flags FROM events"""


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of three types: clicks order-book records, signups symbol mappings, errors error records; others are left out."""
    e = R.book_events(spark, d).where(F.col("event_type").isin("click", "signup", "error"))
    schema = mixed_schema()
    ours = {
        "mbo": {"ts_recv": F.col("ts_recv"), "order_id": F.col("event_id"), "price": F.col("price"), "action": F.lit("A"), "side": F.lit("B"), "flags": F.col("flags")},
        "symbol_mapping": {"stype_in": F.lit(1), "stype_out": F.lit(0), "stype_in_symbol": F.lit("ALL"), "stype_out_symbol": F.concat(F.lit("S"), F.col("event_id").cast("string"))},
        "error": {"err": F.when(F.col("event_id") % 2 == 0, "Internal error").otherwise("Failed to resolve symbol X"), "code": F.lit(255), "is_last": F.lit(255)},
    }
    of = {"mbo": "click", "symbol_mapping": "signup", "error": "error"}
    columns = [(F.col("ts_recv") if c == "ts_event" else F.lit(1) if c == "publisher_id" else F.col(c)).cast(schema[c].dataType).alias(c) for c in HEADER]
    for f in schema:
        if f.name in ours:
            own = F.struct(*[ours[f.name].get(x.name, F.lit("" if x.dataType.simpleString() == "string" else 0)).cast(x.dataType).alias(x.name) for x in f.dataType])
            columns.append(F.when(F.col("event_type") == of[f.name], own).alias(f.name))
        elif f.name not in HEADER:
            columns.append((F.col("ts_recv") if f.name == "index_ts" else F.lit(None)).cast(f.dataType).alias(f.name))
    return e.select(*columns, "event_id")


def mixed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A stream of three types written as one file and read as one table, with live symbols from its own mappings."""
    path = written(spark, mixed(spark, d), "mixed", "event_id")
    rows = loaded(spark, path, "mixed", position="true")
    return symbology.symbols_of(rows, Metadata("XNAS.ITCH", 0), "index_ts", "position").select("rtype", "instrument_id", "index_ts", F.col("mbo.order_id").alias("order_id"), F.col("symbol_mapping.stype_out_symbol").alias("mapped"), F.col("error.err").alias("err"), "symbol")


MIXED = f"""WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'signup', 'error'))
SELECT CAST(CASE event_type WHEN 'click' THEN 160 WHEN 'signup' THEN 22 ELSE 21 END AS SMALLINT) AS rtype, user_id AS instrument_id, {TS} AS index_ts,
  CASE event_type WHEN 'click' THEN event_id END AS order_id, CASE event_type WHEN 'signup' THEN 'S' || event_id END AS mapped,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Internal error' ELSE 'Failed to resolve symbol X' END END AS err,
  last_value(CASE event_type WHEN 'signup' THEN 'S' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS symbol FROM e"""


def mixed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two files, one of three types and one of status records, merged as one stream."""
    a = loaded(spark, written(spark, mixed(spark, d), "mixed", "event_id"), "mixed", position="true")
    status = with_layout(R.statuses(spark, d).withColumn("sequence", F.col("o_orderkey")), "status", ts_event=F.col("ts_recv"), publisher_id=F.lit(2), action=F.lit(7), is_trading=F.lit("Y"))
    b = loaded(spark, written(spark, status, "status", "ts_recv"), "mixed", position="true")
    a, b = (held(spark, rows.select("rtype", "index_ts", "position")) for rows in (a, b))
    whole = merge_streams([a, b], "index_ts", "position", ordered=False)
    return numbered(whole, "pos", ["__key", "__stream", "__position"]).select("pos", F.col("__stream").alias("stream"), "rtype", "index_ts")


MIXED_MERGE = f"""WITH s AS (SELECT 0 AS stream, event_id AS id, {TS} AS index_ts, CASE event_type WHEN 'click' THEN 160 WHEN 'signup' THEN 22 ELSE 21 END AS rtype FROM events
  WHERE event_type IN ('click', 'signup', 'error')
  UNION ALL SELECT 1, row_number() OVER (ORDER BY o_orderdate), epoch_us(o_orderdate) * 1000, 18 FROM orders),
k AS (SELECT *, max(index_ts) OVER (PARTITION BY stream ORDER BY id ROWS UNBOUNDED PRECEDING) AS key FROM s)
SELECT row_number() OVER (ORDER BY key, stream, id) AS pos, stream, CAST(rtype AS SMALLINT) AS rtype, index_ts FROM k"""


def mixed_json_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    mixed(spark, d).select(mixed_json(pretty_ts_=True).alias("value")).write.text(path)
    inside = "hd struct<rtype: int, ts_event: string>, order_id string, stype_out_symbol string, err string"
    return spark.read.text(path).select(F.from_json("value", inside).alias("v")).select(F.col("v.hd.rtype").alias("rtype"), F.col("v.hd.ts_event").alias("ts_event"), "v.order_id", "v.stype_out_symbol", "v.err")


MIXED_JSON = f"""SELECT CASE event_type WHEN 'click' THEN 160 WHEN 'signup' THEN 22 ELSE 21 END AS rtype,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(({TS}) % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS ts_event,
  CASE event_type WHEN 'click' THEN CAST(event_id AS VARCHAR) END AS order_id, CASE event_type WHEN 'signup' THEN 'S' || event_id END AS stype_out_symbol,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Internal error' ELSE 'Failed to resolve symbol X' END END AS err
FROM events WHERE event_type IN ('click', 'signup', 'error')"""


def upgrade_query(kind: str, schema: str, version: int, policy: str, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """Records of a kind written in an old version and read under a policy."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = R.book_events(spark, d).drop("rtype")
        text = F.when(F.col("event_type") == "click", "Heartbeat").when(F.col("event_type") == "view", "Finished x replay").when(F.col("event_type") == "error", "Internal error").otherwise("Warning: slow reading")
        own = {"quantity": F.when(F.col("event_id") % 5 == 0, F.lit(V.UNDEF_STAT_QUANTITY_V1)).otherwise(F.col("event_id")), "raw_symbol": F.col("event_type"), "asset": F.lit("ES"), "raw_instrument_id": F.col("event_id"), "stype_out_symbol": F.col("event_type"), "stype_in_symbol": F.lit("ALL")} | {c: text for c, _ in TEXTS.values()}
        rtype = next(r for r, k in R.RTYPE_OF.items() if k == kind)
        rows = with_layout(e, layout_name(kind, version), ts_event=F.col("event_id"), rtype=F.lit(rtype), **own)
        path = written(spark, rows, schema, "ts_event", version=version)
        return loaded(spark, path, schema, upgrade_policy=policy).select(F.col("ts_event").alias("event_id"), *columns)

    return run


CODE_SQL = {
    "error": "CAST(CASE event_type WHEN 'error' THEN 6 ELSE 255 END AS SMALLINT) AS code, CAST(255 AS SMALLINT) AS is_last",
    "system": "CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 3 WHEN 'error' THEN 255 ELSE 2 END AS SMALLINT) AS code",
    "statistics": "CASE WHEN event_id % 5 = 0 THEN 9223372036854775807 ELSE event_id END AS quantity",
    "statistics_as_is": "CAST(CASE WHEN event_id % 5 = 0 THEN 2147483647 ELSE event_id END AS INTEGER) AS quantity",
    "symbol-mapping": "event_type AS stype_out_symbol, 'ALL' AS stype_in_symbol, CAST(255 AS SMALLINT) AS stype_in, CAST(255 AS SMALLINT) AS stype_out",
    "definition": "event_type AS raw_symbol, 'ES' AS asset, event_id AS raw_instrument_id, 9223372036854775807 AS leg_price, CAST(0 AS INTEGER) AS leg_count, 'N' AS leg_side",
    "definition_v2": "event_type AS raw_symbol, 'ES' AS asset, event_id AS raw_instrument_id, CAST(0 AS BIGINT) AS trading_reference_price",
}
LEGS = ["raw_symbol", "asset", "raw_instrument_id", "leg_price", "leg_count", "leg_side"]


def upgrade_sql(key: str) -> str:
    return f"SELECT event_id, {CODE_SQL[key]} FROM events"


def interval_choice(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by an explicit map of intervals before those of the metadata."""
    spans = {32: [(date(2024, 1, 1), date(2024, 1, 20), "AAPL"), (date(2024, 1, 20), date(2024, 2, 1), "")]}
    meta = Metadata("XNAS.ITCH", 0, schema="mbo", mappings={"MSFT": [(date(2024, 1, 1), date(2024, 2, 1), "32")], "TSLA": [(date(2024, 1, 1), date(2024, 1, 10), "33")]})
    e = R.book_events(spark, d).withColumn("instrument_id", F.col("instrument_id") % 3 + 31)
    named = symbology.symbols_of(e, meta, "ts_recv", "event_id", symbology.interval_map(spark, spans)).withColumnRenamed("symbol", "explicit")
    return symbology.with_symbol(named, interval_frame(spark, meta), "ts_recv").select("event_id", "explicit", "symbol")


INTERVAL_CHOICE = """SELECT event_id, CASE WHEN user_id % 3 = 1 AND ts >= DATE '2024-01-01' AND ts < DATE '2024-01-20' THEN 'AAPL' END AS explicit,
  CASE WHEN user_id % 3 = 1 AND ts >= DATE '2024-01-01' AND ts < DATE '2024-02-01' THEN 'MSFT' WHEN user_id % 3 = 2 AND ts >= DATE '2024-01-01' AND ts < DATE '2024-01-10' THEN 'TSLA' END AS symbol FROM events"""


def dataset_publishers(spark: SparkSession, d: str) -> DataFrame:
    """How many publishers the dataset of each trade's publisher has, and the first."""
    t = R.trades(spark, d).groupBy("publisher_id").agg(F.count(F.lit(1)).alias("n"))
    ids = S.publishers_of(S.publisher_part("publisher_id", "dataset"))
    return t.select("publisher_id", "n", F.size(ids).alias("of_dataset"), F.array_contains(ids, F.col("publisher_id")).alias("own"))


#: How many publishers the datasets have that have more than one.
SEVERAL = {"XNAS.NLS": 5, "XNYS.TRADES": 3, "OPRA.PILLAR": 19, "DBEQ.BASIC": 5, "EQUS.PLUS": 10, "IFEU.IMPACT": 2, "NDEX.IMPACT": 2, "EQUS.ALL": 20, "XNAS.BASIC": 6, "IFUS.IMPACT": 2, "IFLL.IMPACT": 2, "XEUR.EOBI": 2, "XEEE.EOBI": 2, "XCBF.PITCH": 2}


def _dataset_sql() -> str:
    rows = ", ".join(f"({i}, {SEVERAL.get(p.rpartition('.')[0], 1)})" for i, p in enumerate(V.PUBLISHERS, 1))
    return f"""SELECT CAST(l_linenumber % 107 + 1 AS INTEGER) AS publisher_id, count(*) AS n, of_dataset, TRUE AS own FROM lineitem
JOIN (VALUES {rows}) p(i, of_dataset) ON i = l_linenumber % 107 + 1 GROUP BY 1, 3"""


def record_tests(spark: SparkSession, d: str) -> DataFrame:
    """Predicates and codes by type: control records, intervals, heartbeats, classes, undefined prices."""
    e = R.book_events(spark, d)
    kind = F.when(F.col("event_type") == "click", "C").when(F.col("event_type") == "view", "F").when(F.col("event_type") == "signup", "M").otherwise("T")
    bar = F.when(F.col("event_id") % 2 == 0, F.lit(0x21)).otherwise(F.lit(0xC0))
    px = F.when(F.col("event_id") % 9 == 0, F.lit(V.UNDEF_PRICE)).otherwise(F.col("price"))
    return e.select(
        "event_id", S.is_option(kind).alias("option"), S.is_future(kind).alias("future"), S.is_spread(kind).alias("spread"), S.interval_seconds(bar).cast("int").alias("seconds"),
        S.is_heartbeat(F.col("event_id") % 4, F.lit("Heartbeat")).alias("heartbeat"), F.coalesce(F.nanvl(S.px_to_double(px), F.lit(-1.0)), F.lit(0.0)).alias("px"),
        S.enum_name(F.lit("T"), "action").alias("action"), S.enum_code(F.lit("Pro_Rata"), "match_algorithm").alias("matching"), S.clear_flags("flags").cast("int").alias("cleared"),
        S.of_tri_state(F.col("event_id") % 2 == 0).alias("tri"), S.rtype_of_schema(F.lit("tbbo")).cast("int").alias("tbbo"),
    )


RECORD_TESTS = f"""SELECT event_id, event_type NOT IN ('view', 'signup') AS option, event_type = 'view' AS future, event_type NOT IN ('click', 'view') AS spread,
  CASE WHEN event_id % 2 = 0 THEN 60 ELSE 1 END AS seconds, event_id % 4 = 0 AS heartbeat, CASE WHEN event_id % 9 = 0 THEN -1.0 ELSE CAST({PRICE} AS DOUBLE) / 1e9 END AS px,
  'trade' AS action, 'C' AS matching, 0 AS cleared, CASE WHEN event_id % 2 = 0 THEN 'Y' ELSE 'N' END AS tri, 1 AS tbbo FROM events"""


def char_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Every byte as a one-character code, as text output has it."""
    return R.book_events(spark, d).select("event_id", S.escaped_char(F.chr(F.col("event_id") % 256)).alias("shown"))


CHAR_ESCAPES = r"""SELECT event_id, CASE WHEN b = 0 THEN '' WHEN b = 9 THEN '\t' WHEN b = 10 THEN '\n' WHEN b = 13 THEN '\r' WHEN b IN (34, 39, 92) THEN '\' || chr(b)
  WHEN b BETWEEN 32 AND 126 THEN chr(b) ELSE '\x' || lpad(lower(to_hex(b)), 2, '0') END AS shown FROM (SELECT event_id, CAST(event_id % 256 AS INTEGER) AS b FROM events)"""


def split_written(spark: SparkSession, d: str) -> DataFrame:
    """Events split by week, written as one folder for each key, and read back."""
    path = scratch(spark)
    rows = split.split_by_time(R.book_events(spark, d), "ts_recv", "week")
    split.write_split(rows, path, ["event_id"])
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("split", "yyyy-MM-dd").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


SPLIT_WRITTEN = """SELECT strftime(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER), '%Y-%m-%d') AS split, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1"""


def control_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that belong to a schema, and the others, of a stream read as one table."""
    rows = loaded(spark, written(spark, mixed(spark, d), "mixed", "event_id"), "mixed")
    data = filters.data_records(rows).groupBy("rtype").agg(F.count(F.lit(1)).alias("n")).withColumn("data", F.lit(True))
    rest = filters.typed(rows, 0x15, strict=False).groupBy("rtype").agg(F.count(F.lit(1)).alias("n")).withColumn("data", F.lit(False))
    return data.unionByName(rest)


CONTROL = """SELECT CAST(CASE event_type WHEN 'click' THEN 160 ELSE 21 END AS SMALLINT) AS rtype, count(*) AS n, event_type = 'click' AS data FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type"""


def level_flattening(spark: SparkSession, d: str) -> DataFrame:
    """An array of ten levels laid out as columns; levels that are missing are null."""
    e = R.book_events(spark, d)
    level = lambda i: F.struct((F.col("price") - i).alias("bid_px"), (F.col("event_id") + i).alias("bid_sz"))
    rows = e.select("event_id", F.slice(F.array(*[level(i) for i in range(3)]), F.lit(1), (F.col("event_id") % 3 + 1).cast("int")).alias("levels"))
    return filters.flattened(rows, "levels", 3)


LEVELS = "SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 3 >= {i} THEN {PRICE} - {i} END AS bid_px_{i:02}, CASE WHEN event_id % 3 >= {i} THEN event_id + {i} END AS bid_sz_{i:02}" for i in range(3)) + " FROM events"

_UPGRADES = {
    "upgrade_error": ("error", "error", 1, "upgrade_to_v3", ["code", "is_last"], "error"),
    "upgrade_system": ("system", "system", 1, "upgrade_to_v2", ["code"], "system"),
    "upgrade_symbol_mapping": ("symbol_mapping", "symbol-mapping", 1, "upgrade_to_v3", ["stype_out_symbol", "stype_in_symbol", "stype_in", "stype_out"], "symbol-mapping"),
    "upgrade_statistics_v1": ("statistics", "statistics", 1, "upgrade_to_v3", ["quantity"], "statistics"),
    "upgrade_statistics_v2": ("statistics", "statistics", 2, "upgrade_to_v3", ["quantity"], "statistics"),
    "statistics_as_is": ("statistics", "statistics", 1, "as_is", ["quantity"], "statistics_as_is"),
    "upgrade_definition_v1": ("definition", "definition", 1, "upgrade_to_v3", LEGS, "definition"),
    "upgrade_definition_v2": ("definition", "definition", 2, "upgrade_to_v3", LEGS, "definition"),
    "upgrade_definition_to_v2": ("definition", "definition", 1, "upgrade_to_v2", ["raw_symbol", "asset", "raw_instrument_id", "trading_reference_price"], "definition_v2"),
}

#: name -> (query, SQL)
TABLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "binary_round_trip": (binary_query(), BOOK_SQL),
    "binary_zstd": (binary_query(compression="zstd"), BOOK_SQL),
    "binary_slices": (binary_query(read_uniform="true", read_slice_bytes="50000"), BOOK_SQL),
    "fragment_round_trip": (binary_query(mode="fragment"), BOOK_SQL),
    "fragment_zstd": (binary_query(mode="fragment", compression="zstd"), BOOK_SQL),
    "binary_store": (binary_store, BOOK_SQL),
    "binary_order": (binary_order, "SELECT row_number() OVER (ORDER BY event_id) AS pos, event_id AS order_id FROM events"),
    "csv_sink": (csv_sink, CSV_SINK),
    "json_sink": (json_sink, JSON_SINK),
    "mixed_round_trip": (mixed_round_trip, MIXED),
    "mixed_merge": (mixed_merge, MIXED_MERGE),
    "mixed_json_sink": (mixed_json_sink, MIXED_JSON),
    **{name: (upgrade_query(*args), upgrade_sql(key)) for name, (*args, key) in _UPGRADES.items()},
    "interval_choice": (interval_choice, INTERVAL_CHOICE),
    "dataset_publishers": (dataset_publishers, _dataset_sql()),
    "record_tests": (record_tests, RECORD_TESTS),
    "level_flattening": (level_flattening, LEVELS),
    "char_escapes": (char_escapes, CHAR_ESCAPES),
    "split_written": (split_written, SPLIT_WRITTEN),
    "control_records": (control_records, CONTROL),
}
