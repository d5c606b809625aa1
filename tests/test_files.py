"""Files of records: sources, sinks, the command line, old formats, growing files, single records."""

import io
import json
import struct
from datetime import date

import pytest
import zstandard
from pyspark.sql import functions as F

from mktstream import cli
from mktstream.functions import enums, values
from mktstream.functions.records import Record
from mktstream.operators import filters, running, symbology
from mktstream.plans import metadata as M
from mktstream.plans.files import with_layout
from mktstream.sources import text
from mktstream.sources.binary import register
from mktstream.sources.codec import Records, sniff
from mktstream.sources.layouts import LAYOUTS, spark_schema, text_columns

EVENT = 1658441851000000000
DAY = 86400 * 10**9


@pytest.fixture(autouse=True)
def source(spark):
    register(spark)


def mbo(n=3, **own):
    return [Record("mbo", rtype=0xA0, publisher_id=1, instrument_id=323, ts_event=EVENT, ts_recv=EVENT + i, order_id=i, price=5500, size=3, action="A", side="B", **own) for i in range(n)]


def file_of(path, records, meta=None, compression=None):
    data = (meta.encode() if meta else b"") + b"".join(map(bytes, records))
    path.write_bytes(zstandard.ZstdCompressor().compress(data) if compression else data)
    return str(path)


def load(spark, path, schema="mbo", **options):
    return spark.read.format("mktbin").options(schema=schema, **options).load(path)


META = M.Metadata("XNAS.ITCH", EVENT, schema="mbo", end=EVENT + DAY, mappings={"AAPL": [(date(2022, 7, 21), date(2022, 7, 23), "323")]}, symbols=("AAPL",))


def control(n, text):
    return Record("system", rtype=0x17, ts_event=EVENT + n, msg=text, code=0)


@pytest.mark.parametrize("compression", [None, "zstd"])
def test_fragments_and_files_are_sniffed(spark, tmp_path, compression):
    for meta in (None, META):
        path = file_of(tmp_path / f"x{meta is None}", mbo(5), meta, compression)
        assert sorted(r.order_id for r in load(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert load(spark, path, position="true").agg(F.max("position")).first()[0] == len(META.encode()) + 4 * 56


def test_start_of_records_is_that_of_the_file(tmp_path):
    head = bytearray(META.encode() + bytes(8))  # eight bytes of padding that we wouldn't write
    head[4:8] = struct.pack("<I", len(head) - 8)
    for data in (bytes(head), zstandard.ZstdCompressor().compress(bytes(head))):
        (tmp_path / "x").write_bytes(data)
        with open(tmp_path / "x", "rb") as f:
            assert Records(f, {}).start == len(head)


def test_legacy_files(spark, tmp_path):
    rest = struct.pack("<I", 0) + struct.pack("<I", 1) + b"AAPL".ljust(22, b"\0") + struct.pack("<II", 0, 0)
    rest += struct.pack("<I", 1) + b"AAPL".ljust(22, b"\0") + struct.pack("<III", 1, 20220721, 20220723) + b"323".ljust(22, b"\0")
    fixed = M.LEGACY_MAGIC + b"XNAS.ITCH".ljust(16, b"\0") + struct.pack("<HQQQQ", 0, EVENT, EVENT + DAY, 0, 3) + bytes([1, 1, 0]) + bytes(39)
    body = fixed + zstandard.ZstdCompressor().compress(rest)
    data = struct.pack("<II", 0x184D2A51, len(body)) + body + zstandard.ZstdCompressor().compress(b"".join(map(bytes, mbo(3))))
    (tmp_path / "x").write_bytes(data)
    assert sniff(data[:12]) == "legacy"
    assert load(spark, str(tmp_path / "x")).count() == 3
    with open(tmp_path / "x", "rb") as f:
        meta = Records(f, {}).meta
    assert (meta.version, meta.dataset, meta.end, meta.limit, meta.symbols) == (0, "XNAS.ITCH", EVENT + DAY, None, ("AAPL",))
    assert meta.mappings == {"AAPL": [(date(2022, 7, 21), date(2022, 7, 23), "323")]}
    with pytest.raises(M.EncodeError):
        meta.encode()
    assert meta.upgraded(3).version == 3


def test_old_statistics_under_all_policies(spark, tmp_path):
    undefined = values.UNDEF_STAT_QUANTITY_V1
    old = [Record("statistics_v1", rtype=0x18, ts_event=EVENT, ts_recv=EVENT, ts_ref=0, quantity=q, price=1) for q in (7, undefined)]
    meta = M.Metadata("XNAS.ITCH", 0, schema="statistics", version=1)
    path = file_of(tmp_path / "x", old, meta)
    got = lambda **o: sorted(r.quantity for r in load(spark, path, "statistics", **o).collect())
    assert got() == [7, values.UNDEF_STAT_QUANTITY] == got(upgrade_policy="upgrade_to_v3")
    assert got(upgrade_policy="as_is") == [7, undefined] == got(upgrade_policy="upgrade_to_v2")
    fragment = file_of(tmp_path / "y", old)  # the version is told from the sizes
    assert sorted(r.quantity for r in load(spark, fragment, "statistics").collect()) == got()
    new = file_of(tmp_path / "z", mbo(1), META)
    with pytest.raises(Exception, match="upgrade_to_v2 on version 3"):
        load(spark, new, upgrade_policy="upgrade_to_v2").collect()


def test_upgrade_keeps_ts_out(spark, tmp_path):
    old = [Record("error_v1", rtype=0x15, ts_event=EVENT, err="Internal error", ts_out=9)]
    path = file_of(tmp_path / "x", old)
    row = load(spark, path, "error", has_metadata="false", ts_out="true").first()
    assert (row.err, row.code, row.is_last, row.ts_out) == ("Internal error", 6, 255, 9)


def test_mismatch_and_strict_texts(spark, tmp_path):
    path = file_of(tmp_path / "x", [*mbo(2), control(1, "Heartbeat")], META)
    assert load(spark, path).count() == 2 and load(spark, path, "system").first().msg == "Heartbeat"
    with pytest.raises(Exception, match="unexpected record type"):
        load(spark, path, on_mismatch="error").collect()
    bad = bytearray(bytes(control(1, "abc")))
    bad[16:19] = b"\xff\xfeb"
    (tmp_path / "y").write_bytes(bytes(bad))
    assert load(spark, str(tmp_path / "y"), "system").first().msg == ""
    with pytest.raises(Exception, match="UTF-8"):
        load(spark, str(tmp_path / "y"), "system", strict="true").collect()
    with pytest.raises(Exception, match="is null"):
        with_layout(spark.range(1), "mbo", price=F.lit(None)).write.format("mktbin").mode("append").options(schema="mbo", dataset="X").save(str(tmp_path / "z"))


def test_growing_file_stops_at_whole_records(spark, tmp_path):
    data = META.encode() + b"".join(map(bytes, mbo(4)))
    path = tmp_path / "x"

    def step(n):
        path.write_bytes(data[:n])
        stream = spark.readStream.format("mktbin").options(schema="mbo").load(str(path))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.order_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert step(len(data) - 70) == [0, 1]
    assert step(len(data)) == [0, 1, 2, 3]


def transcoded(spark, tmp_path, records, meta, **options):
    from mktstream.streaming.live import transcode

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = str(tmp_path / "lines")
    transcode(spark, file_of(tmp_path / "x", records, meta), out, str(tmp_path / "c"), **options).awaitTermination()
    return out, sorted(r.value for r in spark.read.text(out).collect())


def test_transcoder_of_a_live_stream(spark, tmp_path):
    mapping = lambda n, s: Record("symbol_mapping", rtype=0x16, instrument_id=323, ts_event=EVENT + n, stype_out_symbol=s)
    records = [*mbo(1), mapping(1, "QQQ"), *mbo(1, sequence=7)]
    out, lines = transcoded(spark, tmp_path, records, M.Metadata("XNAS.ITCH", 0), schema="mbo", pretty_px=False, pretty_ts=False)
    assert [x.rpartition(",")[2] for x in lines] == ["", "QQQ"]
    assert (tmp_path / "lines" / "_header").read_text() == text.header("mbo", symbol=True) + "\n"


def test_transcoder_of_a_historical_stream(spark, tmp_path):
    _, lines = transcoded(spark, tmp_path, [*mbo(1), control(3, "x")], META, encoding="json")
    found = [json.loads(x) for x in lines]
    assert {x.get("msg"): x["symbol"] for x in found} == {None: "AAPL", "x": None}


def test_csv_is_quoted_and_json_characters_escaped(spark, tmp_path):
    rows = with_layout(spark.range(1), "system", msg=F.lit('a,"b"\nc'))
    assert text.csv_lines(rows, "system").first().value.endswith(',"a,""b""\nc",0')
    rows = with_layout(spark.range(1), "mbo", action=F.lit("\xff"), side=F.lit("\0"))
    line = text.json_lines(rows, "mbo").first().value
    assert '"action":"\\xff","side":null' in line


def run(spark, *args):
    cli.main(list(map(str, args)), spark)


def test_cli_of_mixed_streams(spark, tmp_path):
    path = file_of(tmp_path / "x.dbn", [*mbo(2), control(5, "a"), *mbo(1)], M.Metadata("XNAS.ITCH", EVENT))
    run(spark, path, "-o", tmp_path / "out.json")
    rtypes = [json.loads(x)["hd"]["rtype"] for x in (tmp_path / "out.json").read_text().splitlines()]
    assert rtypes == [0xA0, 0xA0, 0x17, 0xA0]
    run(spark, path, "-o", tmp_path / "out.dbn", "-l", 3)
    with open(tmp_path / "out.dbn", "rb") as f:
        records = Records(f, {})
        assert records.meta.limit == 3 and records.stream.read() == b"".join(map(bytes, [*mbo(2), control(5, "a")]))
    with pytest.raises(SystemExit):
        run(spark, path, "-o", tmp_path / "out.csv")
    run(spark, path, "-o", tmp_path / "one.csv.zst", "--schema", "mbo")
    data = (tmp_path / "one.csv.zst").read_bytes()
    lines = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read().decode().splitlines()
    assert lines[0] == text.header("mbo") and len(lines) == 4 and data.count(b"\x28\xb5\x2f\xfd") == 1


def test_cli_merges_and_prints_metadata_after_filter_and_limit(spark, tmp_path):
    a = file_of(tmp_path / "a.dbn", mbo(2), META)
    b = file_of(tmp_path / "b.dbn", [Record("trade", rtype=0, instrument_id=1, ts_event=EVENT, ts_recv=EVENT + 1)], M.Metadata("XNAS.ITCH", EVENT + 1, schema="trades"))
    run(spark, a, b, "-o", tmp_path / "m.dbn")
    with open(tmp_path / "m.dbn", "rb") as f:
        records = Records(f, {})
        data = records.stream.read()
    assert records.meta.schema is None and records.meta.end == EVENT + DAY
    assert [data[1], data[57], data[113]] == [0xA0, 0xA0, 0]
    run(spark, a, b, "-m", "-o", tmp_path / "m.json", "--schema", "trades", "-l", 5)
    meta = json.loads((tmp_path / "m.json").read_text())
    assert (meta["schema"], meta["limit"]) == ("trades", "5")


@pytest.mark.parametrize(("by", "pattern", "names"), [("day", "{date}", ["2022-07-21", "2022-07-22"]), ("week", "{date}", ["2022-07-17"]), ("month", "{date}", ["2022-07-01"]), ("symbol", "{symbol}", ["AAPL"]), ("schema", "{schema}", ["mbo"])])
def test_cli_split_parts_have_their_own_metadata(spark, tmp_path, by, pattern, names):
    records = [*mbo(2), Record("mbo", rtype=0xA0, instrument_id=323, ts_event=EVENT, ts_recv=EVENT + DAY)]
    path = file_of(tmp_path / "x.dbn", records, META)
    run(spark, path, "-S", by, "-O", tmp_path / f"p-{pattern}.dbn")
    found = sorted(p.name for p in tmp_path.glob("p-*"))
    assert found == [f"p-{n}.dbn" for n in names]
    with open(tmp_path / found[0], "rb") as f:
        records = Records(f, {})
    assert records.meta.schema == "mbo" and records.meta.symbols == ("AAPL",)
    if by == "day":
        assert records.meta.end == (EVENT // DAY + 1) * DAY and records.meta.mappings == {"AAPL": [(date(2022, 7, 21), date(2022, 7, 22), "323")]}


def test_cli_refuses_what_cannot_be(spark, tmp_path):
    frag = file_of(tmp_path / "x", mbo(2))
    for args in (["-S", "symbol", "-O", "{symbol}.csv", "--input-fragment", frag], ["-S", "day", "-C", frag], [frag], ["-m", "-C", frag], ["-S", "day", "-O", "{date}.csv", frag, frag], ["-o", "x.unknown", frag]):
        with pytest.raises(SystemExit):
            run(spark, *args)
    run(spark, frag, "--input-fragment", "-o", tmp_path / "f.csv")
    assert len((tmp_path / "f.csv").read_text().splitlines()) == 3
    packed = file_of(tmp_path / "y", mbo(2), None, "zstd")
    run(spark, packed, "--input-zstd-fragment", "-S", "day", "-O", tmp_path / "f-{date}.frag.json", "-J")
    assert len((tmp_path / "f-2022-07-21.frag.json").read_text().splitlines()) == 2
    run(spark, packed, "--input-zstd-fragment", "-o", tmp_path / "g.dbn.frag")
    assert (tmp_path / "g.dbn.frag").read_bytes() == b"".join(map(bytes, mbo(2)))


def test_single_records():
    for layout in LAYOUTS:
        rtype = {"definition": 0x13, "statistics": 0x18, "error": 0x15, "system": 0x17, "symbol_mapping": 0x16, "mbo": 0xA0, "trade": 0, "mbp1": 1, "mbp10": 10, "bbo": 0xC3, "cmbp1": 0xB1, "cbbo": 0xC0, "ohlcv": 0x20, "status": 0x12, "imbalance": 0x14}[layout.split("_v")[0]]
        r = Record(layout, rtype=rtype, instrument_id=5)
        assert Record.from_bytes(bytes(r)) == r and r.record_size == LAYOUTS[layout][0]
    r = mbo(1)[0]
    assert (r.px_float("price"), r.ts_datetime("ts_event").isoformat(), r.publisher) == (5.5e-6, "2022-07-21T22:17:31+00:00", "GLBX.MDP3.GLBX")
    assert "price=5500" in repr(r) and len({r, mbo(1)[0]}) == 1
    with pytest.raises(M.ConversionError):
        Record("mbo", nothing=1)
    old = Record("definition_v1", rtype=0x13, raw_symbol="ESH1", raw_instrument_id=7, ts_out=3)
    assert (old.upgraded(2).layout, old.upgraded().layout, old.upgraded().raw_instrument_id, old.upgraded().leg_side, old.upgraded().ts_out) == ("definition_v2", "definition", 7, "N", 3)
    assert r.upgraded() is r and Record("statistics_v1", rtype=0x18, quantity=values.UNDEF_STAT_QUANTITY_V1).upgraded().quantity == values.UNDEF_STAT_QUANTITY


def test_enumerations():
    assert enums.coerce("schema", "MBP_1") == 1 == enums.parse("schema", "mbp-1") == enums.coerce("schema", 1)
    assert enums.coerce("stype", "Native") == 1 and enums.parse("stype", "cms") == 6
    assert enums.variants("side") == ["ask", "bid", "none"] and enums.publishers_of("XNYS.TRADES") == [19, 45, 96]
    for bad in (lambda: enums.parse("schema", "MBO"), lambda: enums.coerce("side", "x"), lambda: enums.publishers_of("X")):
        with pytest.raises(M.ConversionError):
            bad()


def test_mapping_json_and_orientation(spark):
    spans = M.mappings_of_json('{"32": [{"d0": "2023-07-01", "d1": "2023-08-01", "s": "AAPL"}, {"d0": "2023-08-01", "d1": "2023-09-01", "s": ""}]}')
    rows = [(raw, a, b, s, i) for raw, x in spans.items() for i, (a, b, s) in enumerate(x)]
    frame = spark.createDataFrame(rows, "raw_symbol string, start_date date, end_date date, mapped string, ordinal int")
    assert [(r.instrument_id, r.symbol) for r in symbology.oriented(frame, True).collect()] == [(32, "AAPL")]
    with pytest.raises(Exception, match="no instrument"):
        symbology.oriented(frame, False).collect()


def test_running_values_in_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rows = [(i, i % 3, (i * 7919) % 101, str(i) if i % 11 == 0 else None) for i in range(400)]
    frame = spark.createDataFrame(rows, "pos bigint, k int, v bigint, u string").repartition(7)
    got = {r.pos: r.m for r in running.running_max(frame, "m", F.col("v"), "pos").collect()}
    assert got == {i: max(r[2] for r in rows[: i + 1]) for i in range(400)}
    got = {r.pos: r.m for r in running.running_last(frame, "m", F.col("u"), "pos", ["k"]).collect()}
    assert got == {i: next((r[3] for r in rows[i::-1] if r[1] == rows[i][1] and r[3]), None) for i in range(400)}
    got = {r.pos: r.n for r in running.numbered(frame, "n", ["v", "pos"]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    assert running.running_max(frame.limit(0), "m", F.col("v"), "pos").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_frequent_first_value_is_cut_further(spark):
    """Nearly all rows of a merge can have one key; their numbering isn't one task."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    hot = 1_704_067_200_000_000_123 - 2**63
    frame = spark.range(8000).selectExpr(f"IF(id % 20 = 0, id, 0) + {hot} AS __key", "CAST(id % 2 AS INT) AS __stream", "id * 7919 % 8000 AS __position")
    rows = running.numbered(frame, "n", ["__key", "__stream", "__position"]).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((r["__key"], r["__stream"], r["__position"]) for r in rows)
    assert [(r["__key"], r["__stream"], r["__position"]) for r in sorted(rows, key=lambda r: r.n)] == want and [r.n for r in sorted(rows, key=lambda r: r.n)] == list(range(1, 8001))
    sizes = {t: sum(r.task == t for r in rows) for t in {r.task for r in rows}}
    assert max(sizes.values()) < 8000 * 6 // 16
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_files_of_several_types_are_read_in_slices(spark, tmp_path):
    records = [x for i in range(40) for x in (*mbo(i % 4 + 1), control(i, f"text {i}"))]
    path = file_of(tmp_path / "x", records, META)
    rows = load(spark, path, "mixed", position="true", slice_bytes="1000")
    whole = load(spark, path, "mixed", position="true")
    assert rows.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    assert sorted(rows.collect(), key=lambda r: r.position) == sorted(whole.collect(), key=lambda r: r.position) and rows.count() == len(records)
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-3])
    assert load(spark, str(tmp_path / "y"), "mixed", slice_bytes="1000").count() == len(records) - 1
    (tmp_path / "z").write_bytes((tmp_path / "x").read_bytes() + bytes(16))
    with pytest.raises(Exception, match="a record of 0 bytes"):
        load(spark, str(tmp_path / "z"), "mixed", slice_bytes="1000").count()


def test_a_mixed_merge_decodes_its_files_once(spark):
    from mktstream.plans.files import mixed_merge

    plan = mixed_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "mktbin" not in plan and "BatchScan" not in plan


def test_starts_of_slices_follow_the_records(tmp_path, monkeypatch):
    from mktstream.sources import binary

    monkeypatch.setattr(binary, "CHUNK", 100)
    for records in (mbo(30), [x for i in range(20) for x in (*mbo(i % 3), control(i, "x"))]):
        known, at = set(), 0
        for r in records:
            known.add(at)
            at += len(bytes(r))
        path = file_of(tmp_path / "x", records)
        with open(path, "rb") as f:
            for step in (1, 57, 400, 10**6):
                starts = binary.slice_starts(f, 0, step)
                assert starts[0] == 0 and set(starts) <= known and starts == sorted(set(starts))
                assert all(step <= b - a < step + 1020 for a, b in zip(starts, starts[1:])) and (step > 1 or set(starts) == known)


def test_small_slices_of_a_large_file_are_few_tasks(spark, tmp_path):
    path = file_of(tmp_path / "x", mbo(3) * 1000)
    rows = load(spark, path, uniform="true", slice_bytes="56")
    assert rows.rdd.getNumPartitions() <= 600 and rows.count() == 3000


def test_mixed_rows_of_one_kind(spark, tmp_path):
    path = file_of(tmp_path / "x", [*mbo(2), control(1, "a")], META)
    rows = filters.of_kind(load(spark, path, "mixed"), "mbo")
    assert rows.columns == text_columns("mbo") == spark_schema("mbo").names and rows.count() == 2


@pytest.mark.parametrize("compression", [None, "zstd"])
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_push_decoder(compression, step):
    from mktstream.sources.push import PushDecoder

    data = M.Metadata("XNAS.ITCH", EVENT, version=1).encode() + b"".join(map(bytes, [*mbo(2), Record("error_v1", rtype=0x15, err="Internal error"), *mbo(1)]))
    half = len(data) // 2
    sent = zstandard.ZstdCompressor().compress(data[:half]) + zstandard.ZstdCompressor().compress(data[half:]) if compression else data
    decoder, out = PushDecoder(), []
    for i in range(0, len(sent), step):
        decoder.write(sent[i : i + step])
        out += decoder.decode()
    assert out[0].version == 3 and [r.layout for r in out[1:]] == ["mbo", "mbo", "error", "mbo"] and out[3].code == 6 and decoder.buffer() == b""
    decoder.write(bytes(mbo(1)[0])[:20]) if not compression else None
    assert decoder.decode() == [] and len(decoder.buffer()) == (0 if compression else 20)
    with pytest.raises(M.DecodeError):
        decoder.skip(21)
    plain = PushDecoder(has_metadata=False, upgrade_policy="as_is", compression="none")
    plain.write(bytes(Record("error_v1", rtype=0x15, err="x")))
    assert plain.decode()[0].layout == "error_v1"


def test_descriptions_of_fields():
    from mktstream.sources.layouts import describe

    by = {f["column"]: f for f in describe("mbo")}
    assert by["price"]["price"] and by["ts_recv"]["timestamp"] and by["ts_recv"]["order"] == 0 and by["ts_in_delta"]["dtype"] == "<i4" and by["side"]["text"]
    assert any(f["hidden"] for f in describe("definition")) and sorted(f["order"] for f in describe("mbo")) == list(range(14))


def test_files_of_any_store(spark, tmp_path):
    from mktstream.sources.store import read_records

    (tmp_path / "in").mkdir()
    file_of(tmp_path / "in" / "a", mbo(3), META)
    file_of(tmp_path / "in" / "b", [*mbo(2), control(1, "x")], META, "zstd")
    rows = read_records(spark, f"file://{tmp_path}/in", schema="mixed", position="true")
    assert rows.groupBy("file").count().count() == 2 and rows.where("system is not null").first().system.msg == "x" and rows.count() == 6
    assert read_records(spark, f"file://{tmp_path}/in", schema="mbo", upgrade_policy="as_is", input_version="3").count() == 5
    with pytest.raises(ValueError, match="input_version"):
        read_records(spark, f"file://{tmp_path}/in", schema="mbo", upgrade_policy="as_is")
