"""Readers of tables, and the document-question records made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: F.Column) -> F.Column:
    """The words of a text in order: what stands between blanks, tabs and line ends."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_idx, role, words: every conversation is a document, every turn a page."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), "role", words(F.col("text")).alias("words"))
