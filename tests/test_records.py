"""Golden values, metadata, bytes, merge order and live symbols."""

import heapq
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from mktstream.functions import scalar as S
from mktstream.functions import values as V
from mktstream.operators import filters, merge, split, symbology
from mktstream.plans import metadata as M
from mktstream.plans.upgrade import upgrade
from mktstream.sources import text
from mktstream.sources.binary import register
from mktstream.sources.codec import compressed, from_arrow, runs, to_arrow
from mktstream.sources.layouts import LAYOUTS, dtype, spark_schema, text_columns

EVENT = 1658441851000000000


def values(spark, column, kind="bigint", rows=(0,)):
    return [r.v for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column.alias("v")).collect()]


def test_prices(spark):
    rows = [-100000, 32500000000, 101005000000, 0, 9223372036854775807]
    assert values(spark, S.fmt_px("x"), rows=rows) == ["-0.000100000", "32.500000000", "101.005000000", "0.000000000", "UNDEF_PRICE"]
    assert values(spark, S.fmt_px_precision("x", 2), rows=[1999999999, -1999999999]) == ["1.99", "-1.99"]
    assert values(spark, S.fmt_px_precision("x", 0), rows=[1999999999]) == ["1"]
    assert values(spark, S.fmt_px_precision("x", 0, compat=True), rows=[1999999999]) == ["1999999999"]


def test_times(spark):
    assert values(spark, S.fmt_ts("x"), rows=[1662734705128748281, 0]) == ["2022-09-09T14:45:05.128748281Z", ""]
    assert values(spark, S.pretty_ts("x"), rows=[0, -1]) == [None, None]
    assert values(spark, S.index_date("x"), rows=[0, -1]) == [date(1970, 1, 1), None]
    assert [str(v) for v in values(spark, S.unsigned("x"), rows=[-1, 5])] == ["18446744073709551615", "5"]


def test_characters_and_flags(spark):
    assert values(spark, S.escaped_char("x"), "string", ["\0", "\xff", "C", "\t", "\n", ""]) == ["", "\\xff", "C", "\\t", "\\n", ""]
    assert values(spark, S.fmt_flags("x"), rows=[192, 0, 1]) == ["LAST | TOB (192)", "0", "1"]


def test_layouts_have_their_sizes():
    for name in LAYOUTS:
        assert dtype(name).itemsize == LAYOUTS[name][0]
        assert [f.name for f in spark_schema(name)] == text_columns(name)


def mbo(spark, n=3):
    row = (EVENT + 40 * 10**9, EVENT, 160, 1, 323, "B", "B", 5500, 3, 14, 16, 128, 22000, 1002375)
    return spark.createDataFrame([(row[0] + i, *row[1:]) for i in range(n)], spark_schema("mbo"))


def test_csv_and_json(spark):
    line = text.csv_lines(mbo(spark, 1), "mbo").first().value
    assert line == "1658441891000000000,1658441851000000000,160,1,323,B,B,5500,3,14,16,128,22000,1002375"
    j = text.json_lines(mbo(spark, 1), "mbo", pretty_px=True).first().value
    assert j.startswith('{"ts_recv":"1658441891000000000","hd":{"ts_event":"1658441851000000000","rtype":160,')
    assert '"action":"B","side":"B","price":"0.000005500","size":3,"channel_id":14,"order_id":"16","flags":128,"ts_in_delta":22000,"sequence":1002375' in j


@pytest.mark.parametrize("version", [1, 2, 3])
def test_metadata_round_trip(version):
    spans = {"AAPL": [(date(2023, 7, 1), date(2023, 8, 1), "32")]}
    meta = M.Metadata("XNAS.ITCH", EVENT, schema="mbo", end=EVENT + 1, limit=7, symbols=("AAPL", "B"), not_found=("C",), mappings=spans, version=version)
    data = meta.encode()
    assert M.Metadata.decode(data + b"rest") == (meta, len(data))
    assert version < 3 or len(data) % 8 == 0


def test_intervals_merge():
    a, b, c, d = (date(2023, 7, i) for i in (1, 3, 5, 8))
    assert M.merge_intervals([(a, c, "1")], [(b, d, "1")]) == [(a, d, "1")]
    assert M.merge_intervals([(a, b, "1")], [(b, d, "1")]) == [(a, b, "1"), (b, d, "1")]
    with pytest.raises(M.FormatError):
        M.merge_intervals([(a, c, "1")], [(b, d, "2")])


def test_binary_round_trip(spark, tmp_path):
    register(spark)
    rows = mbo(spark, 50).orderBy("ts_recv")
    for compression in ("none", "zstd"):
        path = str(tmp_path / f"x.{compression}")
        rows.write.format("mktbin").mode("append").options(schema="mbo", dataset="XNAS.ITCH", start=str(EVENT), compression=compression).save(path)
        back = spark.read.format("mktbin").options(schema="mbo").load(path)
        assert back.orderBy("ts_recv").collect() == rows.collect()
    parts = spark.read.format("mktbin").options(schema="mbo", uniform="true", slice_bytes="560").load(str(tmp_path / "x.none"))
    assert parts.rdd.getNumPartitions() == 5 and sorted(parts.collect()) == sorted(rows.collect())
    assert spark.read.format("mktbin").options(schema="trades").load(str(tmp_path / "x.none")).count() == 0


def test_unfinished_record_is_left():
    import pyarrow as pa

    row = {c: pa.array([0 if str(k) != "string" else ""], pa.int64() if str(k) != "string" else pa.string()) for c, k in ((f.name, f.dataType.simpleString()) for f in spark_schema("ohlcv"))}
    data = from_arrow(pa.RecordBatch.from_pydict(row), "ohlcv") * 3
    assert [(r[0], r[1], r[3]) for r in runs(data[:-1])] == [(0, 56, 2)]
    many, other = data * 50, bytes([4, 1]) + bytes(14)
    assert [r[3] for r in runs(many + other + many[: 56 * 20] + other * 3)] == [150, 1, 20, 3]
    assert to_arrow(data, 0, 3, "ohlcv", False)["open"].to_pylist() == [0, 0, 0]
    assert compressed(data)


@pytest.mark.parametrize("hints", [None, [5, 1, 50]])
def test_merge_order(spark, hints):
    lists = [[10, 100, 1000], [11, 12, 13, 14, 15, 101, 102, 103, 104, 105], [50, 105, 500, 5000]]
    frames = [spark.createDataFrame(list(enumerate(x)), "pos bigint, ts bigint") for x in lists]
    got = [r.ts for r in merge.merge_streams(frames, "ts", "pos", hints).collect()]
    assert got == [10, 11, 12, 13, 14, 15, 50, 100, 101, 102, 103, 104, 105, 105, 500, 1000, 5000]


def test_merge_of_unsorted_streams_keeps_their_order(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(30) for _ in range(12)] for _ in range(3)]
    heap, want = [(x[0], i, 0) for i, x in enumerate(lists)], []
    heapq.heapify(heap)
    while heap:
        ts, i, k = heapq.heappop(heap)
        want.append((i, k))
        if k + 1 < len(lists[i]):
            heapq.heappush(heap, (lists[i][k + 1], i, k + 1))
    frames = [spark.createDataFrame(list(enumerate(x)), "pos bigint, ts bigint") for x in lists]
    assert [(r["__stream"], r["pos"]) for r in merge.merge_streams(frames, "ts", "pos").collect()] == want


def test_symbols_by_time(spark):
    spans = spark.createDataFrame([(32, date(2023, 7, 1), date(2023, 8, 1), "AAPL", 0), (8029, date(2023, 7, 7), date(2023, 7, 10), "PLTR", 1), (32, date(2023, 7, 5), date(2023, 7, 6), "LATE", 2)], "instrument_id bigint, start_date date, end_date date, symbol string, ordinal int")
    day = lambda d: (d - date(1970, 1, 1)).days * 86400 * 10**9
    rows = spark.createDataFrame([(32, day(date(2023, 7, 2))), (32, day(date(2023, 8, 1))), (32, day(date(2023, 7, 5))), (8029, day(date(2023, 7, 10))), (8029, day(date(2023, 7, 8))), (1, -1)], "instrument_id bigint, ts bigint")
    got = {(r.instrument_id, r.ts): r.symbol for r in symbology.with_symbol(rows, spans, "ts").collect()}
    assert list(got[k] for k in [(r.instrument_id, r.ts) for r in rows.collect()]) == ["AAPL", None, "LATE", None, "PLTR", None]


def test_split_keys(spark):
    ns = lambda *d: (date(*d) - date(1970, 1, 1)).days * 86400 * 10**9 + 36000 * 10**9
    rows = spark.createDataFrame([(ns(2023, 7, 16),), (ns(2023, 7, 18),), (ns(2023, 7, 23),)], "ts bigint")
    assert [r.split for r in split.split_by_time(rows, "ts", "week").collect()] == ["2023-07-16", "2023-07-16", "2023-07-23"]
    with pytest.raises(Exception, match="no time"):
        split.split_by_time(spark.createDataFrame([(-1,)], "ts bigint"), "ts", "day").collect()
    with pytest.raises(ValueError):
        filters.limit_records(rows, 0, ["ts"])


def test_upgrade_of_definitions(spark):
    old = spark.createDataFrame([tuple("x" if f.dataType.simpleString() == "string" else 1 for f in spark_schema("definition_v1"))], spark_schema("definition_v1"))
    new = upgrade(old, "definition", "definition")
    assert new.columns == text_columns("definition")
    row = new.first()
    assert (row.leg_price, row.leg_count, row.raw_symbol) == (9223372036854775807, 0, "x")


def test_command_line_upgrades_old_files(spark, tmp_path):
    import json

    from mktstream import cli

    register(spark)
    row = lambda name, **own: tuple(own.get(f.name, "A" if f.dataType.simpleString() == "string" else 1) for f in spark_schema(name))

    def upgraded(schema, old, version, *flags, **own):
        path, out = str(tmp_path / f"{schema}.{version}.dbn"), str(tmp_path / f"{schema}.{version}{''.join(flags)}.json")
        frame = spark.createDataFrame([row(old, **{"rtype": V.SCHEMA_RTYPE[schema], **own})], spark_schema(old))
        frame.write.format("mktbin").mode("overwrite").options(schema=schema, dataset="XNAS.ITCH", start=str(EVENT), version=version).save(path)
        cli.main([path, *flags, "-o", out, "-J"], spark)
        return json.loads(open(out).read())

    undefined = 2**31 - 1
    assert int(upgraded("statistics", "statistics_v1", 1, "-u", quantity=undefined)["quantity"]) == 2**63 - 1
    assert int(upgraded("statistics", "statistics_v1", 2, "-u", quantity=7)["quantity"]) == 7
    assert int(upgraded("statistics", "statistics_v1", 1, quantity=undefined)["quantity"]) == undefined
    for version in (1, 2):
        new = upgraded("definition", f"definition_v{version}", version, "-u")
        assert (int(new["leg_price"]), new["leg_count"], new["leg_side"]) == (2**63 - 1, 0, "N")
        assert "leg_price" not in upgraded("definition", f"definition_v{version}", version)


def test_live_symbols_as_state(spark, tmp_path):
    from mktstream.streaming.live import with_live_symbol

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0, None), (1, 1, "NFLX"), (1, 2, None), (2, 3, None), (1, 4, "QQQ"), (1, 5, None)]
    spark.createDataFrame(rows, "instrument_id bigint, position bigint, update string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("instrument_id bigint, position bigint, update string").parquet(str(tmp_path / "in"))
    q = with_live_symbol(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.position: r.symbol for r in spark.sql("select * from live").collect()}
    assert got == {0: None, 1: "NFLX", 2: "NFLX", 3: None, 4: "QQQ", 5: "QQQ"}


def test_symbology_plan_has_one_range_join(spark):
    """Small interval tables are broadcast; none of the plan is a nested loop."""
    from mktstream.plans import streams

    d = "/root/testdata/sf0.001"
    named = symbology.with_symbol(streams.trades(spark, d), streams.intervals(spark, d), "ts_recv")
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert named.where(F.col("symbol").isNotNull()).count() > 0


def test_merge_plan_has_no_single_task(spark):
    """The running maximum and the final order are both by ranges."""
    frames = [spark.range(100).selectExpr("id AS pos", "id * 7 % 50 AS ts") for _ in range(2)]
    plan = merge.merge_streams(frames, "ts", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and plan.count("SinglePartition") <= 2  # one row a range is carried in one task


def test_deltas_and_other_scalars(spark):
    from datetime import timedelta

    assert values(spark, S.delta_interval("x"), rows=[1_500_000, -1_500_999]) == [timedelta(microseconds=1500), timedelta(microseconds=-1500)]
    numbers = [i for i, p in enumerate(V.PUBLISHERS, 1) if p.startswith("IFEU.IMPACT.")]
    assert values(spark, S.publishers_of(F.lit("IFEU.IMPACT")), rows=[0]) == [numbers]
    assert values(spark, S.enum_code(F.lit("Pre_Open"), "status_action"), rows=[0]) == [1]
    with pytest.raises(Exception, match="no such value"):
        values(spark, S.enum_name(F.lit("?"), "side", strict=True), rows=[0])
