"""Writers of results, metrics and reports. Rows are written by Spark, so any store will do; a report has a line for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.assembly import results


def write_results(rows: DataFrame, path: str) -> None:
    """JSON lines of questionId, answer, answer_page. rows: question_id, answer, pages."""
    results(rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """id, anchor, positive as Parquet; ids are distinct but not dense."""
    pairs.select(F.monotonically_increasing_id().alias("id"), "anchor", "positive").write.mode("overwrite").parquet(path)


def write_metrics(scores: DataFrame, path: str, measures: list[str], **about: str) -> None:
    """One JSON line: what the run is about, the number of samples and the mean of each measure (a missing one counts as 0)."""
    means = (F.coalesce(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(m) for m in measures)
    totals = scores.agg(F.count("*").alias("n"), *means)
    totals.select(*(F.lit(v).alias(n) for n, v in about.items()), "*").coalesce(1).write.mode("overwrite").json(path)


def report(scores: DataFrame, score: str, classes: dict[str, Column]) -> DataFrame:
    """class, value, n, mean of every value of every class (a column or an array of values a row has), in one pass."""

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("class"), v.cast("string").alias("value")))

    each = [named(n, c) for n, c in classes.items()]
    rows = scores.select(F.col(score).alias("s"), F.explode(F.concat(*(F.coalesce(e, F.array().cast("array<struct<class:string,value:string>>")) for e in each))).alias("c"))
    return rows.groupBy("c.class", "c.value").agg(F.count("*").alias("n"), F.avg(F.coalesce("s", F.lit(0.0))).alias("mean"))


def write_report(scores: DataFrame, path: str, score: str, classes: dict[str, Column]) -> None:
    """The report as text, a line for each value, ordered by class and value. Groups are few: sources, types, kinds of evidence."""
    rows = report(scores, score, classes)
    line = F.format_string("%s | %s | n = %d | mean = %.4f", "class", F.coalesce("value", F.lit("-")), "n", "mean")
    rows.coalesce(1).sortWithinPartitions("class", "value").select(line.alias("value")).write.mode("overwrite").text(path)


def write_layouts(boxes: DataFrame, path: str) -> None:
    """image_name, box_id, box, label, cluster as Parquet; a page's boxes stand together."""
    kept = boxes.select("image_name", "box_id", "box", "label", "cluster")
    kept.repartition("image_name").sortWithinPartitions("image_name", "box_id").write.mode("overwrite").parquet(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """All columns as JSON lines, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def run_summary(scores: DataFrame, measures: list[str], seconds: dict[str, float], **about: str) -> DataFrame:
    """One row: what the run is about, its samples, the means, the share without a score, and each step's seconds, mean and share."""
    n = F.greatest(F.count("*"), F.lit(1))
    means = (F.coalesce(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(m) for m in measures)
    missing = F.count_if(F.col(measures[0]).isNull()) / n
    whole = sum(seconds.values()) or 1.0
    steps = (F.struct(F.lit(float(s)).alias("seconds"), (F.lit(float(s)) / n).alias("mean"), F.lit(s / whole).alias("share")).alias(f"{k}_time") for k, s in seconds.items())
    return scores.agg(F.count("*").alias("n"), *means, missing.alias("failure_rate"), *steps).select(*(F.lit(v).alias(k) for k, v in about.items()), "*")
