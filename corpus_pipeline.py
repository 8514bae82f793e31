"""From raw documents to packed training sequences, in stages that each write a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regista.llm.line_dedup import dedup_lines
from regista.llm.mixing import mixed
from regista.llm.near_dedup import drop_near_duplicates
from regista.llm.packing import pack
from regista.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts are rejected; rows that repeat share a verdict."""
    return accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has already, and without documents of which no line is left. Of rows that repeat doc_id and text one keeps its lines; null ids come after all others."""
    return dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more), the one with the smallest doc_id. Texts without a word all stay; unlike rows under one doc_id, or without one, are judged each by itself."""
    return drop_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, which may be not at all. A null source is a source; rows that repeat are taken as rows of their own."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; a null text has the end mark alone, and rows that repeat are documents of their own."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixing", mixing), ("packing", packing)]
#: No SQL for run(): MinHash bands, pivotal draws and the tokenizer have no counterpart in it. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
