"""Ranking, filtering and choosing answers. Ties go to the smaller key, so results don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, by: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    """The k best rows of each group, with rank from 1; partial top-k runs before the exchange."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank(scored: DataFrame, by: list[str], score: str, ties: list[str], threshold: float, most: int, least: int) -> DataFrame:
    """Rows at or above the threshold, `most` at the most; if fewer than `least` pass, the best `least` whatever their score."""
    group = Window.partitionBy(*by)
    ranked = scored.withColumn("new_rank", F.row_number().over(group.orderBy(F.desc(score), *ties)))
    ranked = ranked.withColumn("n_pass", F.count_if(F.col(score) >= threshold).over(group))
    enough = F.col("n_pass") >= least
    keep = (enough & (F.col(score) >= threshold) & (F.col("new_rank") <= most)) | (~enough & (F.col("new_rank") <= least))
    return ranked.filter(keep)


def best(rows: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the largest score of each group."""
    return top_k(rows, by, score, ties, 1).drop("rank")


def page_vote(rows: DataFrame, by: list[str], page: str, weight: Column) -> DataFrame:
    """The page of the largest summed weight, and that sum; ties go to the first page."""
    sums = rows.groupBy(*by, page).agg(F.sum(weight).alias("votes"))
    chosen = F.max_by(F.struct(page, "votes"), F.struct(F.round("votes", 6), -F.col(page))).alias("v")
    return sums.groupBy(*by).agg(chosen).select(*by, F.col(f"v.{page}").alias(page), F.col("v.votes").alias("votes"))
