"""Registered queries of the record operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktstream.functions import scalar as S
from mktstream.functions import values as V
from mktstream.operators import filters, merge, split, symbology
from mktstream.operators.running import numbered
from mktstream.plans import files
from mktstream.plans import streams as R
from mktstream.plans.metadata import Metadata
from mktstream.plans.upgrade import error_code, stat_quantity, system_code

KEY = R.TRADE_KEY

T_SQL = """t AS (SELECT epoch_us(l_shipdate) * 1000 AS ts_recv, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 AS price,
  l_partkey AS instrument_id, l_linenumber % 107 + 1 AS publisher_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity FROM lineitem)"""
E_SQL = """e AS (SELECT event_id, epoch_us(ts) * 1000 AS ts_recv, ts, user_id AS instrument_id, event_type, CAST(round(value * 100) AS BIGINT) * 10000000 AS price,
  CASE event_type WHEN 'click' THEN 160 WHEN 'view' THEN 1 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 22 WHEN 'error' THEN 21 END AS rtype, event_id % 256 AS flags FROM events)"""
I_SQL = """i AS (SELECT p_partkey AS instrument_id, DATE '1995-01-01' AS a, DATE '1997-01-01' AS b, p_brand || '.A' AS symbol, 0 AS ordinal FROM part
  UNION ALL SELECT p_partkey, DATE '1997-01-01', DATE '1999-01-01', p_brand || '.B', 1 FROM part
  UNION ALL SELECT p_partkey, DATE '1996-06-01', DATE '1997-06-01', p_brand || '.C', 2 FROM part WHERE p_partkey % 10 = 0)"""
PX_SQL = "CAST(CAST({p} AS DECIMAL(38,0)) * CAST(0.000000001 AS DECIMAL(10,9)) AS DECIMAL(29,9))::VARCHAR"
TS_SQL = "strftime({t}, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(({n}) % 1000000000 AS VARCHAR), 9, '0') || 'Z'"


def symbology_ts(spark: SparkSession, d: str) -> DataFrame:
    return symbology.with_symbol(R.trades(spark, d), R.intervals(spark, d), "ts_recv").select(*KEY[:4], "ts_recv", "price", "symbol")


SYMBOLOGY_TS = f"""WITH {T_SQL}, {I_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ts_recv, price,
  (SELECT max_by(symbol, ordinal) FROM i WHERE i.instrument_id = t.instrument_id AND t.l_shipdate >= a AND t.l_shipdate < b) AS symbol FROM t"""


def symbology_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Mappings from ids to symbols, as metadata have them whose input symbols are ids."""
    meta = Metadata("XNAS.ITCH", 0, "raw_symbol", stype_in="instrument_id")
    mappings = R.intervals(spark, d).select(F.col("instrument_id").cast("string").alias("raw_symbol"), "start_date", "end_date", F.col("symbol").alias("mapped"), "ordinal")
    return symbology.with_symbol(R.statuses(spark, d), symbology.oriented(mappings, meta.is_inverse()), "ts_recv").select("o_orderkey", "ts_recv", "symbol")


SYMBOLOGY_INVERSE = f"""WITH {I_SQL} SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS ts_recv,
  (SELECT max_by(symbol, ordinal) FROM i WHERE i.instrument_id = o_custkey AND o_orderdate >= a AND o_orderdate < b) AS symbol FROM orders"""


def symbology_pit(spark: SparkSession, d: str) -> DataFrame:
    spans = R.intervals(spark, d).withColumn("mapping", F.col("instrument_id"))
    symbols = symbology.intervals_at(spans, F.lit("1996-07-01").cast("date"))
    return symbology.with_symbol_at(R.trades(spark, d), symbols).select(*KEY[:4], "ts_recv", "price", "symbol")


SYMBOLOGY_PIT = f"""WITH {T_SQL}, {I_SQL}, p AS (SELECT instrument_id, min_by(symbol, ordinal) AS symbol FROM i WHERE a <= DATE '1996-07-01' AND DATE '1996-07-01' < b GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ts_recv, price, symbol FROM t LEFT JOIN p USING (instrument_id)"""


def symbology_live(spark: SparkSession, d: str) -> DataFrame:
    update = F.when(F.col("rtype") == 0x16, F.concat(F.lit("S"), F.col("event_id").cast("string")))
    return symbology.with_live_symbol(R.book_events(spark, d), "event_id", update).select("event_id", "instrument_id", "symbol")


SYMBOLOGY_LIVE = f"""WITH {E_SQL} SELECT event_id, instrument_id, last_value(CASE WHEN rtype = 22 THEN 'S' || event_id END IGNORE NULLS)
  OVER (PARTITION BY instrument_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS symbol FROM e"""


def _merged(spark: SparkSession, d: str, hints: list[int | None] | None) -> DataFrame:
    a = R.book_events(spark, d).select("ts_recv", F.col("event_id").alias("id"))
    b = R.statuses(spark, d).select("ts_recv", F.col("o_orderkey").alias("id"))
    whole = merge.merge_streams([a, b], "ts_recv", "id", hints, ordered=False)
    return numbered(whole, "pos", ["__key", "__stream", "__position"]).select("pos", F.col("__stream").alias("stream"), "id", "ts_recv")


def merge_streams(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, None)


def merge_hinted(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, [1_000_000_000_000_000_000, None])


def _merge_sql(hint: str) -> str:
    return f"""WITH s AS (SELECT 0 AS stream, event_id AS id, epoch_us(ts) * 1000 AS ts_recv, {hint} AS hint FROM events
  UNION ALL SELECT 1, o_orderkey, epoch_us(o_orderdate) * 1000, 0 FROM orders),
k AS (SELECT *, max(greatest(ts_recv, hint)) OVER (PARTITION BY stream ORDER BY id ROWS UNBOUNDED PRECEDING) AS key FROM s)
SELECT row_number() OVER (ORDER BY key, stream, id) AS pos, stream, id, ts_recv FROM k"""


def schema_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.schema_filter(R.book_events(spark, d), "tbbo").select("event_id", "rtype", "ts_recv")


def limit_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.schema_filter(R.book_events(spark, d), "mbo")
    return filters.limit_records(rows, 100, ["event_id"]).select("event_id", "rtype", "price")


def split_query(unit: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = split.split_by_time(R.book_events(spark, d), "ts_recv", unit)
        return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum("price").alias("price_sum"))

    return run


def split_sql(day: str) -> str:
    return f"WITH {E_SQL} SELECT strftime({day}, '%Y-%m-%d') AS split, count(*) AS n, min(event_id) AS first_id, CAST(sum(price) AS BIGINT) AS price_sum FROM e GROUP BY 1"


def split_symbol(spark: SparkSession, d: str) -> DataFrame:
    known = symbology.with_symbol(R.trades(spark, d), R.intervals(spark, d), "ts_recv").where(F.col("symbol").isNotNull())
    return split.split_by_symbol(known).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts_recv").alias("start_ts"))


SPLIT_SYMBOL = f"WITH x AS ({SYMBOLOGY_TS}) SELECT symbol AS split, count(*) AS n, min(ts_recv) AS start_ts FROM x WHERE symbol IS NOT NULL GROUP BY 1"


def split_schema_skip(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_schema(R.book_events(spark, d), "skip").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_schema_broadcast(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_schema(R.book_events(spark, d), "broadcast", "event_id").select("event_id", "rtype", "split")


SCHEMA_SQL = "CASE rtype WHEN 160 THEN 'mbo' WHEN 1 THEN 'mbp-1' WHEN 0 THEN 'trades' END"
SPLIT_BROADCAST = f"""WITH {E_SQL}, s AS (SELECT event_id, rtype, {SCHEMA_SQL} AS split FROM e), b AS (SELECT split, min(event_id) AS begun FROM s WHERE split IS NOT NULL GROUP BY 1)
SELECT event_id, CAST(rtype AS SMALLINT) AS rtype, split FROM s WHERE split IS NOT NULL
UNION ALL SELECT s.event_id, CAST(s.rtype AS SMALLINT), b.split FROM s JOIN b ON s.event_id > b.begun WHERE s.split IS NULL"""


def price_text(spark: SparkSession, d: str) -> DataFrame:
    t = R.trades(spark, d)
    signed = F.when(F.col("l_linenumber") % 2 == 0, -F.col("price")).otherwise(F.col("price"))
    p = F.when(F.col("l_orderkey") % 50 == 0, F.lit(V.UNDEF_PRICE)).otherwise(signed)
    return t.select(*KEY[:4], "price", S.fmt_px(p).alias("px"), S.fmt_px_precision(p, 2).alias("px2"), S.fmt_px_precision(p, 5).alias("px5"), S.fmt_px_precision(p, 0).alias("px0"), F.coalesce(S.px_to_decimal(p), F.lit(0).cast("decimal(20,9)")).cast("double").alias("px_value"))


def _price_sql() -> str:
    p = "CASE WHEN l_orderkey % 50 = 0 THEN 9223372036854775807 WHEN l_linenumber % 2 = 0 THEN -price ELSE price END"
    text = PX_SQL.format(p="p")
    return f"""WITH {T_SQL}, x AS (SELECT *, {p} AS p FROM t), y AS (SELECT *, {text} AS f FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, CASE WHEN p = 9223372036854775807 THEN 'UNDEF_PRICE' ELSE f END AS px,
  CASE WHEN p = 9223372036854775807 THEN 'UNDEF_PRICE' ELSE left(f, length(f) - 7) END AS px2, CASE WHEN p = 9223372036854775807 THEN 'UNDEF_PRICE' ELSE left(f, length(f) - 4) END AS px5,
  CASE WHEN p = 9223372036854775807 THEN 'UNDEF_PRICE' ELSE left(f, length(f) - 10) END AS px0, CASE WHEN p = 9223372036854775807 THEN 0 ELSE CAST(f AS DOUBLE) END AS px_value FROM y"""


def time_text(spark: SparkSession, d: str) -> DataFrame:
    e = R.book_events(spark, d).withColumn("t", F.col("ts_recv") + F.col("event_id") % 1000)
    return e.select("event_id", S.fmt_ts("t").alias("text"), S.index_date("t").alias("day"), S.date_int(S.index_date("t")).alias("day_int"), S.pretty_ts(F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("t"))).alias("pretty"))


def _time_sql() -> str:
    text = TS_SQL.format(t="ts", n="ts_recv + event_id % 1000")
    return f"""WITH {E_SQL} SELECT event_id, {text} AS text, CAST(ts AS DATE) AS day, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_int,
  CASE WHEN event_id % 7 <> 0 THEN {text} END AS pretty FROM e"""


def flag_text(spark: SparkSession, d: str) -> DataFrame:
    e = R.book_events(spark, d)
    return e.select("event_id", S.fmt_flags("flags").alias("text"), *[S.has_flag("flags", n).alias(n.lower()) for n in V.FLAGS], S.set_flag("flags", "LAST").cast("int").alias("with_last"))


def _flag_sql() -> str:
    names = ", ".join(f"CASE WHEN flags & {v} <> 0 THEN '{n}' END" for n, v in V.FLAGS.items())
    tests = ", ".join(f"flags & {v} <> 0 AS {n.lower()}" for n, v in V.FLAGS.items())
    return f"""WITH {E_SQL}, x AS (SELECT *, concat_ws(' | ', {names}) AS f FROM e)
SELECT event_id, CASE WHEN f = '' THEN CAST(flags AS VARCHAR) ELSE f || ' (' || flags || ')' END AS text, {tests}, CAST(flags | 128 AS INTEGER) AS with_last FROM x"""


def rtype_maps(spark: SparkSession, d: str) -> DataFrame:
    e = R.book_events(spark, d)
    return e.select("event_id", S.schema_of_rtype("rtype").alias("schema"), S.rtype_name("rtype").alias("rtype_name"))


RTYPE_MAPS = f"""WITH {E_SQL} SELECT event_id, {SCHEMA_SQL} AS schema,
  CASE rtype WHEN 160 THEN 'mbo' WHEN 1 THEN 'mbp-1' WHEN 0 THEN 'mbp-0' WHEN 22 THEN 'symbol-mapping' WHEN 21 THEN 'error' END AS rtype_name FROM e"""


def publishers(spark: SparkSession, d: str) -> DataFrame:
    t = R.trades(spark, d)
    dataset, venue = S.publisher_part("publisher_id", "dataset"), S.publisher_part("publisher_id", "venue")
    return t.groupBy("publisher_id").agg(F.count(F.lit(1)).alias("n")).select("publisher_id", "n", dataset.alias("dataset"), venue.alias("venue"), S.publisher_of(dataset, venue).alias("again"))


def _publisher_sql() -> str:
    rows = ", ".join(f"({i}, '{p.rpartition('.')[0]}', '{p.rpartition('.')[2]}')" for i, p in enumerate(V.PUBLISHERS, 1))
    return f"WITH {T_SQL}, p(i, dataset, venue) AS (VALUES {rows}) SELECT publisher_id, count(*) AS n, dataset, venue, publisher_id AS again FROM t JOIN p ON i = publisher_id GROUP BY 1, 3, 4"


def char_states(spark: SparkSession, d: str) -> DataFrame:
    li = R.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return li.select("l_returnflag", "l_linestatus", "n", S.escaped_char("l_returnflag").alias("shown"), S.tri_state(F.when(F.col("l_returnflag") == "A", "Y").otherwise(F.col("l_returnflag"))).alias("state"), S.lookup("l_returnflag", V.ACTIONS).alias("action"))


CHAR_STATES = """SELECT l_returnflag, l_linestatus, count(*) AS n, l_returnflag AS shown, CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END AS state,
  CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'clear' WHEN 'N' THEN 'none' END AS action FROM lineitem GROUP BY 1, 2"""


def upgrade_codes(spark: SparkSession, d: str) -> DataFrame:
    msg = F.when(F.col("event_type") == "click", "Heartbeat").when(F.col("event_type") == "view", "Finished x replay").when(F.col("event_type") == "error", "Internal error").otherwise("Warning: slow reading")
    q = F.when(F.col("event_id") % 5 == 0, F.lit(V.UNDEF_STAT_QUANTITY_V1)).otherwise(F.col("event_id"))
    return R.book_events(spark, d).select("event_id", system_code(msg).cast("int").alias("system_code"), error_code(msg).cast("int").alias("error_code"), stat_quantity(q).alias("quantity"))


UPGRADE_CODES = """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 3 WHEN 'error' THEN 255 ELSE 2 END AS system_code,
  CASE event_type WHEN 'error' THEN 6 ELSE 255 END AS error_code, CASE WHEN event_id % 5 = 0 THEN 9223372036854775807 ELSE event_id END AS quantity FROM events"""


def csv_text(spark: SparkSession, d: str) -> DataFrame:
    e = R.book_events(spark, d)
    line = F.concat_ws(",", S.pretty_ts("ts_recv"), F.col("rtype").cast("string"), F.col("instrument_id").cast("string"), S.fmt_px("price"), F.col("flags").cast("string"))
    return e.select("event_id", line.alias("line"))


def _csv_sql() -> str:
    return f"""WITH {E_SQL} SELECT event_id, {TS_SQL.format(t="ts", n="ts_recv")} || ',' || rtype || ',' || instrument_id || ',' || {PX_SQL.format(p="price")} || ',' || flags AS line FROM e"""


def json_text(spark: SparkSession, d: str) -> DataFrame:
    e = R.book_events(spark, d)
    line = F.concat(F.lit('{"ts_recv":"'), S.pretty_ts("ts_recv"), F.lit('","rtype":'), F.col("rtype").cast("string"), F.lit(',"price":"'), S.fmt_px("price"), F.lit('"}'))
    return e.select("event_id", line.alias("line"))


def _json_sql() -> str:
    return f"""WITH {E_SQL} SELECT event_id, '{{"ts_recv":"' || {TS_SQL.format(t="ts", n="ts_recv")} || '","rtype":' || rtype || ',"price":"' || {PX_SQL.format(p="price")} || '"}}' AS line FROM e"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Two streams merged, one schema kept, symbols resolved, the first thousand in merge order."""
    a = R.book_events(spark, d).select("ts_recv", "rtype", "instrument_id", "price", F.col("event_id").alias("id"))
    b = R.statuses(spark, d).select("ts_recv", "rtype", "instrument_id", F.lit(0).cast("long").alias("price"), F.col("o_orderkey").alias("id"))
    whole = filters.schema_filter(merge.merge_streams([a, b], "ts_recv", "id", ordered=False), "status")
    first = filters.limit_records(whole, 1000, ["__key", "__stream", "__position"])
    return symbology.with_symbol(first, R.intervals(spark, d), "ts_recv").select("id", "ts_recv", "instrument_id", "symbol")


FLAGSHIP = f"""WITH {I_SQL}, k AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) * 1000 AS ts_recv, o_orderdate, o_custkey AS instrument_id,
  max(o_orderdate) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS key FROM orders), f AS (SELECT * FROM k ORDER BY key, id LIMIT 1000)
SELECT id, ts_recv, instrument_id, (SELECT max_by(symbol, ordinal) FROM i WHERE i.instrument_id = f.instrument_id AND o_orderdate >= a AND o_orderdate < b) AS symbol FROM f"""

#: name -> (query, SQL)
TABLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship": (flagship, FLAGSHIP),
    "symbology_ts": (symbology_ts, SYMBOLOGY_TS),
    "symbology_inverse": (symbology_inverse, SYMBOLOGY_INVERSE),
    "symbology_pit": (symbology_pit, SYMBOLOGY_PIT),
    "symbology_live": (symbology_live, SYMBOLOGY_LIVE),
    "merge_streams": (merge_streams, _merge_sql("0")),
    "merge_hinted": (merge_hinted, _merge_sql("1000000000000000000")),
    "schema_filter": (schema_filter, f"WITH {E_SQL} SELECT event_id, CAST(rtype AS SMALLINT) AS rtype, ts_recv FROM e WHERE rtype = 1"),
    "limit_filtered": (limit_filtered, f"WITH {E_SQL} SELECT event_id, CAST(rtype AS SMALLINT) AS rtype, price FROM e WHERE rtype = 160 ORDER BY event_id LIMIT 100"),
    "split_day": (split_query("day"), split_sql("CAST(ts AS DATE)")),
    "split_week": (split_query("week"), split_sql("CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER)")),
    "split_month": (split_query("month"), split_sql("date_trunc('month', ts)")),
    "split_symbol": (split_symbol, SPLIT_SYMBOL),
    "split_schema_skip": (split_schema_skip, f"WITH {E_SQL} SELECT {SCHEMA_SQL} AS split, count(*) AS n FROM e WHERE rtype IN (0, 1, 160) GROUP BY 1"),
    "split_schema_broadcast": (split_schema_broadcast, SPLIT_BROADCAST),
    "price_text": (price_text, _price_sql()),
    "time_text": (time_text, _time_sql()),
    "flag_text": (flag_text, _flag_sql()),
    "rtype_maps": (rtype_maps, RTYPE_MAPS),
    "publishers": (publishers, _publisher_sql()),
    "char_states": (char_states, CHAR_STATES),
    "upgrade_codes": (upgrade_codes, UPGRADE_CODES),
    **files.TABLE,
    "csv_text": (csv_text, _csv_sql()),
    "json_text": (json_text, _json_sql()),
}
