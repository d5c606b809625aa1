"""Dedup of lines across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.llm.common import ascii_lower, dropped, free_names, written

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lost_positions(docs: DataFrame, id_col: str, text_col: str, min_len: int, min_docs: int) -> DataFrame:
    """(id, text_hash, lost): the positions of the lines that go, of documents that lose one.

    Lines are exploded with their position and hashed at once, so a line that many documents share is one small row for
    each. Of each hash only the smallest identifier and whether enough documents hold it are kept. These come back to
    the lines by the hash as a struct: so their table is shuffled once more, alone, and Spark can split the lines of a hot hash.
    """
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key"))
    keys = written(lines.where(F.length("key") >= min_len).select("id", "text_hash", "pos", F.unhex(F.sha2("key", 256)).alias("hash")), "line-keys")
    holders = F.min("id") < F.max("id") if min_docs == 2 else F.count_distinct("id") >= min_docs
    common = keys.groupBy("hash").agg(F.min("id").alias("stays"), holders.alias("common")).where("common").select(F.col("hash").alias("of"), "stays")
    gone = keys.join(common, F.struct(F.col("hash").alias("of")) == F.struct("of")).where(F.col("id") > F.col("stays"))
    # Rows that repeat an identifier and a text give each position more than once.
    lost = written(gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("lost")), "line-lost")
    dropped(keys)
    return lost


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_len: int, min_docs: int) -> tuple[DataFrame, Column, Column]:
    """docs with lines dropped and helper columns, and the columns n_lines and n_dropped."""
    gone_id, gone_hash, lost = free_names(docs.columns, "gone_id", "gone_hash", "lost")
    gone = lost_positions(docs, id_col, text_col, min_len, min_docs).toDF(gone_id, gone_hash, lost)
    joined = docs.join(gone, (F.col(id_col) == F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_hash)), "left")
    n_lines = free_names(joined.columns, "line_count")[0]
    lines = lines_of(F.col(text_col))
    joined = joined.withColumn(n_lines, F.size(lines))
    stay = F.array_except(F.sequence(F.lit(0), F.col(n_lines) - 1), F.col(lost))
    kept = F.when(F.col(lost).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(_picked(lines, stay))
    n_dropped = F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long")
    return joined.withColumn(text_col, kept), F.col(n_lines).cast("long"), n_dropped


def _picked(lines: Column, positions: Column) -> Column:
    """The lines at the positions, joined. The array is made once: it goes into the transform as the one element of an array."""
    return F.element_at(F.transform(F.array(lines), lambda all_: F.array_join(F.transform(positions, lambda p: all_[p]), "\n")), 1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the lines dropped that other documents hold, and the columns n_lines and n_dropped.

    Lines are parted at \\n. A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at
    least min_len code points in at least min_docs documents lose all their lines except in the smallest
    identifier that holds them; all other lines stay, in order. Null and empty texts are one empty line and
    come back empty. Rows with a null identifier count for no key and keep their lines. Rows that repeat an
    identifier are one document, each with its own lines. An empty table stays empty; long texts are taken whole, in time
    that grows with their lines; further columns pass through whatever their names, but for n_lines and n_dropped, which are replaced.
    """
    rest = docs.drop("n_lines", "n_dropped")
    out, n_lines, n_dropped = _deduped(rest, id_col, text_col, min_len, min_docs)
    return out.select(*rest.columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 10, min_docs: int = 2) -> DataFrame:
    """line_dedup() with the columns of docs alone, whatever their names."""
    return _deduped(docs, id_col, text_col, min_len, min_docs)[0].select(*docs.columns)
