"""Exact dedup by a stateful stream, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mktstream.llm.common import ascii_lower, conf_of, fresh_path, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def keyed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Identifier, normalised text, its digest, and where the row lies."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm"), at.alias("at")).withColumn("digest", digest(F.col("norm")))


def update_state(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Take the rows of path that state hasn't seen, and return the state: digest, keep (id, at), n.

    The state is a streaming aggregation without watermark, so keys never expire; RocksDB holds it on
    disk and each batch is checkpointed in the folder state, where a rerun goes on from. Equal texts
    combine before the shuffle, so a large group reaches its state partition as one row a task. Batches
    emit the keys they touched; keep and n only grow, so the largest of each digest is the newest.
    """
    with conf_of(spark, STATE_CONF):
        # As a glob: the file source takes a plain path for a directory, and a table may be one file.
        source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
        best = F.max(F.struct("id", "at")).alias("keep")
        seen = keyed(source, id_col, text_col, digest).groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))

        def keep_batch(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{state}/touched/batch={batch}")

        query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(keep_batch).start()
        query.awaitTermination()
    try:
        touched = spark.read.parquet(f"{state}/touched")
    except Exception as e:  # no rows at all: no batch ran
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "digest binary, keep struct<id: bigint, at: struct<file: string, row: bigint>>, n bigint")
    return touched.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row for each row of the Parquet table at path, with the row that stays of its equal texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if identical after lower-casing
    A-Z; null counts as empty. Of equal texts the largest identifier stays, of rows that tie in it (repeated
    rows, or null identifiers, which come below all others) the one that lies last. An empty table gives no
    rows; further columns aren't read. state: a folder that a later call goes on from; without one the run
    has its own in the shared folder.

    Rows whose digest is shared are checked by their full bytes against the row that the state's locator
    names; texts that differ though their digests agree are grouped by the bytes themselves.
    """
    seen = written(update_state(spark, path, state or fresh_path(spark, "exact-state"), id_col, text_col, digest), "exact-seen")
    rows = keyed(spark.read.parquet(path), id_col, text_col, digest)
    shared = seen.where("n > 1")
    hits = written(rows.join(shared, "digest").select("digest", "at", "id", "norm", F.col("keep.at").alias("keep_at")), "exact-hits")
    stays = hits.where(F.col("at") == F.col("keep_at")).select("digest", F.col("norm").alias("keep_norm"))
    differs = hits.join(stays, "digest").where(F.col("norm") != F.col("keep_norm")).select("digest", "norm", "id", "at")
    differs = written(differs, "exact-differs")
    out = rows.select("digest", "id", "at", F.sha2("norm", 256).alias("sha")).join(seen, "digest", "left")
    if differs.isEmpty():
        own, size = F.col("keep"), F.col("n")
    else:
        apart = differs.groupBy("digest", "norm").agg(F.max(F.struct("id", "at")).alias("own"), F.count(F.lit(1)).alias("own_n"))
        less = apart.groupBy("digest").agg(F.sum("own_n").alias("less"))
        placed = differs.join(apart, ["digest", "norm"]).select("at", "own", "own_n")
        out = out.join(placed, "at", "left").join(less, "digest", "left")
        own, size = F.coalesce("own", "keep"), F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0)))
    return out.select(F.col("id").alias("doc_id"), own["id"].alias("keep_id"), size.alias("group_size"), (F.col("at") == own["at"]).alias("kept"), F.col("sha").alias("text_sha256"))
