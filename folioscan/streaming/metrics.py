"""Running totals of scores that arrive in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_means(scores: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """n and the mean of each measure so far in each group; a missing score counts as 0. Works on streams and on tables."""
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in measures))


def write_snapshots(means: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """After each batch, the totals so far as Parquet in folder/batch=<number>; a batch that is run again overwrites its own."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return means.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
