"""A training corpus from raw documents: quality, lines, near copies, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktstream.llm.bpe import encode_decode
from mktstream.llm.common import table, written
from mktstream.llm.decontam import without_benchmark
from mktstream.llm.entry import byte_bpe_path
from mktstream.llm.line_dedup import without_repeated_lines
from mktstream.llm.ngram_join import Rule, without_near_copies
from mktstream.llm.quality import keep_good

NEAR = Rule(words=5, num=80, den=100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are rated as documents without words, repeated rows each."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and n_chars follows; documents stay, even without text, which then is empty."""
    return without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; documents without words, and rows without doc_id, stay."""
    return without_near_copies(docs, NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; documents without words stay."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back; a null text has no ids."""
    return encode_decode(docs, byte_bpe_path(), digests=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again.

    Every stage takes nulls in any column, empty, very long and repeated texts and further columns, and gives an empty table for an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
