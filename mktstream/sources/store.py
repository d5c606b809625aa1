"""Record files of any store that Spark reads, such as HDFS or an object store."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructType

from mktstream.plans.upgrade import POLICIES, check_policy
from mktstream.sources.binary import MIXED, RecordDecoder, flag
from mktstream.sources.codec import CHUNK, Records
from mktstream.sources.layouts import mixed_schema, schema_layout, spark_schema


def read_records(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """The records of files as the source mktbin gives them, with the column `file`; options as there.

    Spark's own reader fetches the files, each whole by one task (up to its limit of 2 GB a file), so they need no mounted folder;
    many files are read in parallel. upgrade_policy=as_is needs input_version, as no file is looked into beforehand; ts_out has
    to be said if the files have it.
    """
    policy = options.get("upgrade_policy", "upgrade_to_v3")
    if POLICIES.get(policy) is None and "input_version" not in options:
        check_policy(policy, 3)
        raise ValueError("as_is needs input_version")
    version, ts_out = POLICIES[policy] or int(options["input_version"]), flag(options, "ts_out")
    schema = mixed_schema(version, ts_out) if options["schema"] == MIXED else spark_schema(schema_layout(options["schema"], version), ts_out)
    if flag(options, "position"):
        schema = schema.add("position", LongType())
    rows = StructType([*schema.fields]).add("file", StringType())
    own = options | {"version_out": str(version)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = RecordDecoder(own, schema)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = Records(io.BufferedReader(io.BytesIO(content.as_buffer())), own)
                at, held = records.start, b""
                while data := records.stream.read(CHUNK):
                    held += data
                    made, used = decoder.batches(held, records.version, records.ts_out, at)
                    held, at = held[used:], at + used
                    for b in made:
                        yield b.append_column("file", pa.array([name] * len(b), pa.string()))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, rows)
