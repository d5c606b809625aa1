"""Command line: record files to files, merged, filtered, limited, split and rendered.

python -m mktstream.cli INPUT... [-o OUTPUT] [-J | -C | -T | -D | -F] [--schema S] [-l N] [-p] [-s] [-u DAY] ...
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from dataclasses import replace
from datetime import date, timedelta

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktstream.functions.values import RTYPE_SCHEMA
from mktstream.operators.filters import limit_records
from mktstream.operators.merge import merge_streams
from mktstream.operators.split import split_by_schema, split_by_symbol, split_by_time
from mktstream.operators.symbology import with_symbol
from mktstream.plans.metadata import Metadata, filtered, interval_frame, merge
from mktstream.plans.metadata import split_by_schema as split_metadata_by_schema
from mktstream.plans.metadata import split_by_symbol as split_metadata_by_symbol
from mktstream.plans.metadata import split_by_time as split_metadata_by_time
from mktstream.plans.upgrade import check_policy
from mktstream.sources.binary import MIXED, register, version_out
from mktstream.sources.codec import Records, from_arrow, metadata_of, mixed_bytes
from mktstream.sources.layouts import index_column, mixed_schema, schema_layout, spark_schema
from mktstream.sources.text import csv_line, header, json_object, mixed_json

#: Output encoding and compression by suffix, longest first.
SUFFIXES = {
    ".dbn.frag.zst": ("fragment", True), ".dbn.frag": ("fragment", False), ".dbn.zst": ("binary", True), ".dbn": ("binary", False), ".csv.zst": ("csv", True),
    ".csv": ("csv", False), ".tsv.zst": ("tsv", True), ".xls.zst": ("tsv", True), ".tsv": ("tsv", False), ".xls": ("tsv", False), ".json.zst": ("json", True), ".json": ("json", False),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mktstream")
    p.add_argument("input", nargs="+")
    p.add_argument("-o", "--output")
    p.add_argument("-O", "--output-pattern")
    p.add_argument("-S", "--split-by", choices=["day", "week", "month", "symbol", "schema"])
    kind = p.add_mutually_exclusive_group()
    for short, long in (("-J", "json"), ("-C", "csv"), ("-T", "tsv"), ("-D", "binary"), ("-F", "fragment")):
        kind.add_argument(short, f"--{long}", action="store_const", const=long, dest="encoding")
    p.add_argument("-z", "--zstd", action="store_true")
    p.add_argument("-u", "--upgrade", action="store_true")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("-m", "--metadata", action="store_true")
    p.add_argument("-p", "--pretty", action="store_true")
    p.add_argument("-s", "--map-symbols", action="store_true")
    p.add_argument("-l", "--limit", type=int)
    fragment = p.add_mutually_exclusive_group()
    fragment.add_argument("--input-fragment", action="store_true")
    fragment.add_argument("--input-zstd-fragment", action="store_true")
    p.add_argument("--input-dbn-version", type=int, dest="input_version")
    p.add_argument("--schema")
    p.add_argument("--omit-header", action="store_true")
    return p


def encoding_of(args: argparse.Namespace) -> tuple[str, bool]:
    """The encoding and whether it is compressed: as flags say, else by the suffix of the output or of its pattern."""
    if args.encoding:
        return args.encoding, args.zstd
    output = args.output or args.output_pattern
    if output is None:
        raise SystemExit("cannot tell the encoding without an output")
    for suffix, found in SUFFIXES.items():
        if output.endswith(suffix):
            return found
    raise SystemExit(f"cannot tell the encoding of {output}")


def checked(args: argparse.Namespace) -> argparse.Namespace:
    encoding, _ = encoding_of(args)
    args.fragment = args.input_fragment or args.input_zstd_fragment
    if args.limit is not None and args.limit < 1:
        raise SystemExit("the limit must not be zero")
    if args.metadata and (encoding != "json" or args.fragment):
        raise SystemExit("metadata is printed as JSON only")
    if args.pretty and encoding in ("binary", "fragment") or args.map_symbols and (args.fragment or encoding in ("binary", "fragment")):
        raise SystemExit("binary output has neither pretty fields nor symbols")
    if args.split_by and len(args.input) > 1:
        raise SystemExit("several inputs cannot be split")
    if args.split_by and not args.output_pattern:
        raise SystemExit("a split needs an output pattern")
    if args.split_by == "symbol" and args.fragment:
        raise SystemExit("a fragment has no symbols to split by")
    if args.fragment and encoding == "binary":
        raise SystemExit("a fragment has no metadata to write")
    return args


def read_options(args: argparse.Namespace, schema: str) -> dict[str, str]:
    options = {"schema": schema, "upgrade_policy": "upgrade_to_v3" if args.upgrade else "as_is", "position": "true"}
    if args.fragment:
        options |= {"has_metadata": "false", "compression": "zstd" if args.input_zstd_fragment else "none"}
    if args.input_version:
        options["input_version"] = str(args.input_version)
    return options


class Output:
    """A file or the screen, compressed as one frame if asked for."""

    def __init__(self, path: str | None, zstd: bool, force: bool):
        if path is not None and os.path.exists(path) and not force:
            raise SystemExit(f"{path} exists")
        self.file = sys.stdout.buffer if path is None else open(path, "wb")
        self.to = zstandard.ZstdCompressor(write_checksum=True).stream_writer(self.file, closefd=False) if zstd else self.file
        self.zstd, self.screen = zstd, path is None

    def put(self, data: bytes) -> None:
        self.to.write(data)

    def close(self) -> None:
        if self.zstd:
            self.to.close()
        self.file.flush()
        if not self.screen:
            self.file.close()


def payload(rows: DataFrame, encoding: str, schema: str, version: int, ts_out: bool, args: argparse.Namespace) -> DataFrame:
    """(split, data): rows of equal split that follow each other as bytes, in the order of rows."""
    if encoding in ("binary", "fragment"):
        kept = rows.select("split", *[c for c in (mixed_schema(version, ts_out) if schema == MIXED else spark_schema(schema_layout(schema, version), ts_out)).names])

        def made(batch: pa.RecordBatch) -> bytes:
            return mixed_bytes(batch, version, ts_out) if schema == MIXED else from_arrow(batch, schema_layout(schema, version), ts_out)
    else:
        flags = {"pretty_px": args.pretty, "pretty_ts_": args.pretty, "ts_out": ts_out, "symbol": args.map_symbols}
        if encoding == "json":
            line = mixed_json(version, **flags) if schema == MIXED else json_object(schema_layout(schema, version), **flags)
        else:
            line = csv_line(schema_layout(schema, version), separator(encoding), **flags)
        kept = rows.select("split", line.alias("value"))

        def made(batch: pa.RecordBatch) -> bytes:
            return "".join(v + "\n" for v in batch.column("value").to_pylist()).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in spans], pa.string()), pa.array([made(batch.slice(a, b - a)) for a, b in spans], pa.binary())], ["split", "data"])

    return kept.mapInArrow(run, "split string, data binary")


def separator(encoding: str) -> str:
    return "\t" if encoding == "tsv" else ","


def head_of(encoding: str, schema: str, version: int, ts_out: bool, meta: Metadata | None, args: argparse.Namespace) -> bytes:
    """What stands before the records: metadata, or the header of CSV."""
    if encoding == "binary":
        return replace(meta, version=max(1, meta.version)).encode()
    if encoding in ("csv", "tsv") and not args.omit_header:
        return (header(schema_layout(schema, version), ts_out, args.map_symbols, separator(encoding)) + "\n").encode()
    return b""


def part_metadata(meta: Metadata | None, by: str, key: str) -> Metadata | None:
    """The metadata of one part of a split."""
    if meta is None:
        return None
    if by == "symbol":
        return split_metadata_by_symbol(meta, key)
    if by == "schema":
        return split_metadata_by_schema(meta, key)
    first = date.fromisoformat(key)
    after = {"day": first + timedelta(days=1), "week": first + timedelta(days=7), "month": (first.replace(day=1) + timedelta(days=31)).replace(day=1)}[by]
    return split_metadata_by_time(meta, first, after)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Merge, filter by schema, limit, add symbols, split and render, in this order; metadata follow each step.

    Records come out of Spark in their order, and the driver writes them to the one output file, or the file of their part, as they come.
    """
    args = checked(parser().parse_args(argv))
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    register(spark)
    encoding, zstd = encoding_of(args)
    policy = "upgrade_to_v3" if args.upgrade else "as_is"
    metas = [] if args.fragment else [metadata_of(p) for p in args.input]
    metas = [m.upgraded(check_policy(policy, m.version)) for m in metas]
    meta = filtered(merge(metas), args.schema, args.limit) if metas else None
    if args.metadata:
        out = Output(args.output, zstd, args.force)
        out.put((meta.to_json(args.pretty, args.pretty) + "\n").encode())
        return out.close()
    schema = args.schema or (MIXED if encoding not in ("csv", "tsv") else (meta.schema if meta else first_schema(args)))
    if schema is None:
        raise SystemExit("CSV needs a schema: the stream has several")
    options = read_options(args, schema)
    version, ts_out = (max(1, meta.version), meta.ts_out) if meta else version_out(options | {"path": args.input[0]})
    ts = "index_ts" if schema == MIXED else index_column(schema_layout(schema, version))
    parts = [spark.read.format("mktbin").options(**options).load(p) for p in args.input]
    rows = merge_streams(parts, ts, "position", [m.start for m in metas] or None, ordered=False) if len(parts) > 1 else parts[0].withColumns({"__key": F.lit(0), "__stream": F.lit(0), "__position": F.col("position")})
    order = ["__key", "__stream", "__position"]
    rows = limit_records(rows, args.limit, order)
    if args.map_symbols or args.split_by == "symbol":
        rows = with_symbol(rows, interval_frame(spark, meta), ts)
    by = args.split_by
    if by is None:
        keyed = rows.withColumn("split", F.lit(""))
    else:
        keyed = split_by_symbol(rows) if by == "symbol" else split_by_schema(rows) if by == "schema" else split_by_time(rows, ts, by)
    found = payload(keyed.orderBy("split", *order), encoding, schema, version, ts_out, args)
    mark = {"symbol": "{symbol}", "schema": "{schema}"}.get(by, "{date}")
    at, out = None, None
    for r in found.toLocalIterator():
        if r.split != at:
            if out:
                out.close()
            at = r.split
            out = Output(args.output_pattern.replace(mark, at) if by else args.output, zstd, args.force)
            out.put(head_of(encoding, schema, version, ts_out, part_metadata(meta, by, at) if by else meta, args))
        out.put(r.data)
    if out is None and by is None:
        out = Output(args.output, zstd, args.force)
        out.put(head_of(encoding, schema, version, ts_out, meta, args))
    if out:
        out.close()


def first_schema(args: argparse.Namespace) -> str | None:
    """The schema of the first record of a fragment, whose header a text output gets."""
    with open(args.input[0], "rb") as f:
        head = Records(f, read_options(args, MIXED)).stream.read(2)
    return RTYPE_SCHEMA.get(head[1]) if len(head) > 1 else None


if __name__ == "__main__":
    main()
