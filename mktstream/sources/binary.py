"""The data source `mktbin`: record files read as DataFrames or streams, and written.

Options for reading: path (a file, folder or glob that Python's open reads on every executor); schema (names the
record layout: one of the schemas, error, symbol-mapping, system, or mixed for all records as one table);
upgrade_policy (upgrade_to_v3, upgrade_to_v2 or as_is: the version whose layout the rows have); input_version and
ts_out (of records without metadata; without input_version the version is told from record sizes); has_metadata
(sniffed); compression (sniffed: none or zstd); on_mismatch (skip or error: records of another type); strict (false:
texts without end or that aren't UTF-8 are empty, else an error); position (false, or true: a column with the byte
at which the record lies, by which a stream's order can be restored); uniform (false, or true if an uncompressed
file holds records of one type only) and slice_bytes (64 MiB: the least part of an uncompressed file that one task
reads; less than 64 MiB grow towards them as a file would else be more than MOST_SLICES tasks).

Options for writing: schema, dataset, start, end, limit, stype_in, stype_out, symbols (JSON list), mappings (JSON,
see mappings_of_json), version, ts_out, mode (`file` with metadata or `fragment`), compression (none or zstd).
"""

from __future__ import annotations

import glob
import io
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from mktstream.functions.values import SCHEMA_RTYPE
from mktstream.plans.metadata import DecodeError, Metadata, mappings_of_json
from mktstream.plans.upgrade import POLICIES, check_policy, upgrade_columns
from mktstream.sources.codec import CHUNK, Gathered, Records, compressed, from_arrow, layout_of, mixed_batch, mixed_bytes, runs, to_arrow
from mktstream.sources.layouts import KIND, layout_name, mixed_schema, rtype_of, schema_layout, spark_schema

MIXED = "mixed"
SLICE = 64 << 20
#: So many tasks read a file at most, unless each of them reads SLICE bytes.
MOST_SLICES = 512


def files_of(path: str) -> list[str]:
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        return sorted(os.path.join(local, n) for n in os.listdir(local) if not n.startswith(("_", ".")))
    return sorted(glob.glob(local))


def flag(options: dict, name: str) -> bool:
    return options.get(name, "false").lower() == "true"


def version_out(options: dict) -> tuple[int, bool]:
    """The version of the rows, and whether they have ts_out, by the policy and the first file."""
    policy = options.get("upgrade_policy", "upgrade_to_v3")
    version, ts_out = options.get("input_version"), flag(options, "ts_out")
    for path in files_of(options["path"])[:1]:
        with open(path, "rb") as f:
            records = Records(f, options)
        version, ts_out = records.version, records.ts_out
    return check_policy(policy, int(version)) if version else POLICIES.get(policy) or 3, ts_out


class Slice(InputPartition):
    """Bytes [start, end) of a file; end None: to its end. All of a compressed file is one slice."""

    def __init__(self, path: str, start: int, end: int | None, version: int | None, ts_out: bool, size: int = 0):
        self.path, self.start, self.end, self.version, self.ts_out, self.size = path, start, end, version, ts_out, size


def slice_starts(f: io.BufferedReader, start: int, step: int) -> list[int]:
    """Where the slices of a file begin, each at a record and step bytes or a little more behind the last.

    Sizes are followed from record to record. What can't be followed is left to the last slice, whose task says so.
    """
    out, base, at, goal = [start], start, 0, start + step
    f.seek(start)
    while data := f.read(CHUNK):
        view = np.frombuffer(data, np.uint8)
        while at < len(data):
            stop = min(len(data), goal - base)
            first = data[at]
            count = -(-(stop - at) // max(16, first * 4))
            if first >= 4 and (view[at : at + (count - 1) * first * 4 + 1 : first * 4] == first).all():
                at += count * first * 4
            while at < stop:
                if data[at] < 4:
                    return out
                at += data[at] * 4
            if base + at >= goal:
                out.append(base + at)
                goal = base + at + step
        base, at = base + len(data), at - len(data)
    return [a for a in out if a < base]


class RecordDecoder:
    def __init__(self, options: dict, schema: StructType):
        self.mixed = options["schema"] == MIXED
        self.rtype = None if self.mixed else rtype_of(options["schema"])
        self.version = int(options["version_out"])
        self.layout = None if self.mixed else schema_layout(options["schema"], self.version)
        self.refuse = options.get("on_mismatch", "skip") == "error"
        self.strict, self.position = flag(options, "strict"), flag(options, "position")
        self.names = schema.names
        self.schema = to_arrow_schema(StructType([f for f in schema if f.name != "position"]))

    def batches(self, data: bytes, version: int | None, ts_out: bool, at: int, size: int = 0) -> tuple[list[pa.RecordBatch], int]:
        """Arrow batches of the whole records in data, and the bytes they take; data lies at byte `at` of its stream."""
        records = Gathered(data)
        layouts, wanted = {}, []
        for g, (rtype, width, numbers) in enumerate(records.groups()):
            if size and width != size:
                raise DecodeError(f"records of {size} and of {width} bytes in a file read as uniform")
            if self.rtype not in (None, rtype) or rtype not in KIND:
                if self.refuse:
                    raise DecodeError(f"unexpected record type {rtype:#x}")
                continue
            source = layout_of(rtype, width, version, ts_out)
            layouts[g] = source, self.layout or layout_name(KIND[rtype], self.version)
            wanted.append((rtype, width, numbers, source))
        out = []
        if self.mixed and wanted:
            numbers = np.sort(np.concatenate([w[2] for w in wanted]))
            out.append((mixed_batch(records, layouts, ts_out, self.schema, self.strict), numbers))
        for rtype, width, numbers, source in [] if self.mixed else wanted:
            columns = to_arrow(records.bytes_of(numbers, width), 0, len(numbers), source, ts_out, self.strict)
            columns = upgrade_columns(columns, KIND[rtype], source, self.layout)
            out.append((pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(numbers), f.type)) for f in self.schema], schema=self.schema), numbers))
        if self.position:
            out = [(batch.append_column("position", pa.array(at + records.offsets[numbers])), numbers) for batch, numbers in out]
        return [batch.select(self.names) for batch, _ in out], records.used


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.decoder_schema = dict(options), schema
        self.options["version_out"] = str(version_out(options)[0])
        self.none = False

    def pushFilters(self, filters: list[Filter]):
        """A filter on another record type leaves nothing to read."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("rtype",) and self.options["schema"] != MIXED and f.value != rtype_of(self.options["schema"]):
                self.none = True
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.none:
            return []
        width, out = int(self.options.get("slice_bytes", SLICE)), []
        for path in files_of(self.options["path"]):
            with open(path, "rb") as f:
                records = Records(f, self.options)
                head = records.stream.peek(1)[:1]
                size, total = head[0] * 4 if head else 0, os.path.getsize(path)
                if records.compressed or size < 16:
                    out.append(Slice(path, records.start, None, records.version, records.ts_out))
                    continue
                step = max(width, min(SLICE, -(-total // MOST_SLICES)))
                if flag(self.options, "uniform"):
                    step = max(size, step // size * size)
                    starts = list(range(records.start, total, step))
                else:
                    size, starts = 0, slice_starts(f, records.start, step)
            out += [Slice(path, a, b, records.version, records.ts_out, size) for a, b in zip(starts, [*starts[1:], total])]
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        decoder = RecordDecoder(self.options, self.decoder_schema)
        with open(part.path, "rb") as f:
            stream = Records(f, self.options).stream
            if part.end is not None:
                stream.seek(part.start)
            at, held = part.start, b""
            left = None if part.end is None else part.end - part.start
            while data := stream.read(CHUNK if left is None else min(CHUNK, left)):
                left = None if left is None else left - len(data)
                held += data
                batches, used = decoder.batches(held, part.version, part.ts_out, at, part.size)
                held, at = held[used:], at + used
                yield from batches


class BinaryStreamReader(DataSourceStreamReader):
    """One growing, uncompressed file: offsets are bytes at which a record ends, so an unfinished one waits for the next batch."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.decoder_schema = dict(options), schema
        self.options["version_out"] = str(version_out(options)[0])
        self.path = options["path"].removeprefix("file://")
        with open(self.path, "rb") as f:
            records = Records(f, self.options)
        if records.compressed:
            raise DecodeError("a compressed file can't be followed")
        self.begin, self.version, self.ts_out = records.start, records.version, records.ts_out
        self.whole = self.begin

    def initialOffset(self) -> dict:
        return {"at": self.begin}

    def latestOffset(self) -> dict:
        with open(self.path, "rb") as f:
            f.seek(self.whole)
            held = b""
            while data := f.read(CHUNK):
                held += data
                used = sum(size * count for _, size, _, count in runs(held))
                held, self.whole = held[used:], self.whole + used
        return {"at": self.whole}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(self.path, start["at"], end["at"], self.version, self.ts_out)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        decoder = RecordDecoder(self.options, self.decoder_schema)
        with open(part.path, "rb") as f:
            f.seek(part.start)
            at, held, left = part.start, b"", part.end - part.start
            while data := f.read(min(CHUNK, left)):
                left, held = left - len(data), held + data
                batches, used = decoder.batches(held, part.version, part.ts_out, at)
                held, at = held[used:], at + used
                yield from batches

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    def __init__(self, path: str, partition: int):
        self.path, self.partition = path, partition


class BinaryWriter(DataSourceArrowWriter):
    """Tasks write parts beside the target in a folder both can reach; the driver joins them in partition order."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.target = options["path"].removeprefix("file://")
        self.folder = f"{self.target}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        number, version, ts_out = TaskContext.get().partitionId(), int(self.options.get("version", 3)), flag(self.options, "ts_out")
        path = f"{self.folder}/{number:06}-{uuid.uuid4().hex}"
        with open(path, "wb") as f:
            for batch in batches:
                data = mixed_bytes(batch, version, ts_out) if self.options["schema"] == MIXED else from_arrow(batch, schema_layout(self.options["schema"], version), ts_out)
                f.write(compressed(data) if self.options.get("compression") == "zstd" else data)
        return Written(path, number)

    def commit(self, messages: list[Written]) -> None:
        o = self.options
        if os.path.exists(self.target) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.target)
        with open(self.target + ".new", "wb") as out:
            if o.get("mode", "file") == "file":
                head = metadata_from(o).encode()
                out.write(compressed(head) if o.get("compression") == "zstd" else head)
            for m in sorted((m for m in messages if m), key=lambda m: m.partition):
                with open(m.path, "rb") as part:
                    while data := part.read(CHUNK):
                        out.write(data)
        os.replace(self.target + ".new", self.target)
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            os.remove(f"{self.folder}/{name}")
        if os.path.isdir(self.folder):
            os.rmdir(self.folder)


def metadata_from(options: dict) -> Metadata:
    """The metadata that options for writing tell of."""
    o, number = options, lambda name: int(options[name]) if name in options else None
    return Metadata(
        o["dataset"], int(o.get("start", 0)), o.get("stype_out", "instrument_id"), o["schema"] if o["schema"] in SCHEMA_RTYPE else None, number("end"), number("limit"), o.get("stype_in", "raw_symbol"),
        flag(o, "ts_out"), int(o.get("version", 3)), tuple(json.loads(o.get("symbols", "[]"))), mappings=mappings_of_json(o.get("mappings", "{}")),
    )


class BinarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mktbin"

    def schema(self) -> StructType:
        version, ts_out = version_out(self.options)
        mixed = self.options["schema"] == MIXED
        out = mixed_schema(version, ts_out) if mixed else spark_schema(schema_layout(self.options["schema"], version), ts_out)
        return out.add("position", LongType()) if flag(self.options, "position") else out

    def reader(self, schema: StructType) -> BinaryReader:
        return BinaryReader(self.options, schema)

    def streamReader(self, schema: StructType) -> BinaryStreamReader:
        return BinaryStreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BinaryWriter:
        return BinaryWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make mktbin known to the session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinarySource)
