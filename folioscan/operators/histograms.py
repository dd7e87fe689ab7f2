"""Several histograms of one table in one pass over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histograms(rows: DataFrame, values: dict[str, Column], units: dict[str, Column] | None = None) -> DataFrame:
    """kind, value, n: how many rows have each value, for every kind of value, and how many units have each number of rows.

    values: numbers; a null is counted as a null. units: what rows belong to (a page, a document); they are counted by the
    rows that they have. All kinds come from one reading of the rows, by grouping sets; units are counted once more behind it.
    """
    units = units or {}
    names = [*values, *units]
    held = rows.select(*(c.cast("double").alias(k) for k, c in values.items()), *(c.alias(k) for k, c in units.items()))
    once = held.groupingSets([[F.col(n)] for n in names], *map(F.col, names)).agg(F.count("*").alias("n"), F.grouping_id().alias("set"))
    # A set's number has a bit for each column that it leaves out.
    number = {n: (1 << len(names)) - 1 - (1 << (len(names) - 1 - i)) for i, n in enumerate(names)}
    kind = reduce(lambda c, n: c.when(F.col("set") == number[n], n), names, F.when(F.lit(False), ""))
    unit = F.col("set").isin([number[n] for n in units])
    value = F.coalesce(*map(F.col, values), F.lit(None).cast("double"))
    told = once.select(kind.alias("kind"), F.when(unit, F.col("n").cast("double")).otherwise(value).alias("value"), F.when(unit, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"))
    return told.groupBy("kind", "value").agg(F.sum("n").alias("n"))
