"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder is made, which only a local master may use.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="mktstream-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def conf_of(spark: SparkSession, settings: dict[str, str]):
    """The settings hold inside the block; what was set before holds again after it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """For many jobs over tables of their own: Python gets few rows at once, so texts and bitmaps take little memory on either
    side, the driver builds no broadcasts but those that are asked for, and a job's shuffle files go when it ends, not when the
    driver's heap lets go of them: what is read again is written."""
    return conf_of(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


#: How many rows a file of an intermediate table takes at least, where a bound of their number is known beforehand.
ROWS_PER_FILE = 50_000


def few(df: DataFrame, rows: int | None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """df in no more partitions than its at most so many rows call for; None: as it is."""
    return df if rows is None else df.coalesce(max(1, -(-rows // per_file)))


def written(df: DataFrame, label: str, rows: int | None = None, per_file: int = ROWS_PER_FILE, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and the planner knows its real size.

    rows: what df has at most. Tables of few rows then take few files, however many partitions a shuffle has.
    path: where earlier parts of the table lie; the table is then all of it.
    """
    path = path or fresh_path(df.sparkSession, label)
    few(df, rows, per_file).write.mode("append").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def counted(df: DataFrame, label: str, *metrics: Column, rows: int | None = None, per_file: int = ROWS_PER_FILE, path: str | None = None) -> tuple[DataFrame, dict]:
    """written(), with the number of rows and further sums that are taken as the rows are written, without a job of their own."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), label, rows, per_file, path)
    return table, seen.get


def in_rounds(rounds: int, keys: list[str], of_share, label: str, *metrics: Column, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> tuple[DataFrame, dict]:
    """counted() in so many rounds: of_share makes of a condition on the keys what holds for that share of them.

    The shuffle files of a round go before the next, so the disk holds those of one.
    """
    table, sums = None, {}
    for k in range(rounds):
        share = F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k if rounds > 1 else F.lit(True)
        table, seen = counted(of_share(share), label, *metrics, rows=rows, per_file=per_file, path=None if table is None else table.written_to)
        sums = {name: sums.get(name, 0) + n for name, n in seen.items()}
        if rounds > 1:
            tidy(table.sparkSession)
    return table, sums


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables from written() that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage between the phases of a long job.

    Spark removes the shuffle files and broadcasts of finished plans only when the driver's heap lets go of them, which may be
    much later; until then they fill the executors' disks, and the driver's heap keeps growing.
    """
    spark.sparkContext._jvm.System.gc()


#: A table whose rows take fewer bytes together may be broadcast.
BROADCAST_BYTES = 16 << 20


def is_small(rows: int, columns: int) -> bool:
    """Whether so many narrow rows stay below the bound; a column counts 32 bytes."""
    return rows * columns * 32 < BROADCAST_BYTES


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many narrow rows, with a broadcast hint if these stay below the bound."""
    return F.broadcast(df) if is_small(rows, len(df.columns)) else df


def planned_once(spark: SparkSession):
    """For jobs whose partitions are even and whose joins are settled: plans aren't changed while they run, which would cost
    the driver a thread and a plan for every exchange."""
    return conf_of(spark, {"spark.sql.adaptive.enabled": "false"})


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are; texts that are all ASCII take the quick way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column of a table has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
