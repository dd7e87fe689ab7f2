"""Word chunks, evidence and patches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChunkRule:
    size: int = 60
    tolerance: float = 0.2
    overlap: int = 10

    def __post_init__(self) -> None:
        if not (self.size > 1 and 0 <= self.tolerance <= 1 and 0 <= self.overlap < self.size):
            raise ValueError(f"no such chunks: {self}")


def chunk_ranges(n: Column, rule: ChunkRule = ChunkRule()) -> Column:
    """Array of (start, end, prev): word ranges of the chunks of a unit of n words; none for an empty unit.

    Windows of `size` words begin every size - overlap words. One joins the chunk before it if that stays within the
    tolerance by the fold's own count (prev), which takes overlap words off each window that joins. Windows that are full
    join in groups of equal size, so their chunks follow by arithmetic; only the last group and the few windows that reach
    over the end are folded, one after the other.
    """
    step = rule.size - rule.overlap
    most = rule.size * (1 + rule.tolerance)
    group = 1 + int((most - rule.size) // step)
    windows, full = F.ceil(n / step).cast("int"), F.when(n >= rule.size, F.floor((n - rule.size) / step).cast("int") + 1).otherwise(0)
    last = F.floor((full - 1) / group).cast("int")  # the number of the group that is still open; -1 for none
    kind = "array<struct<start:int,end:int,prev:int>>"
    none = F.array().cast(kind)

    def closed(g: Column) -> Column:
        start = (g * (group * step)).cast("int")
        return F.struct(start.alias("start"), (start + (group - 1) * step + rule.size).alias("end"), F.lit((group - 1) * step + rule.size).alias("prev"))

    left = full - last * group - 1  # windows of the open group beyond its first
    first = (last * (group * step)).cast("int")
    open_ = F.struct(first.alias("start"), (first + left * step + rule.size).cast("int").alias("end"), (left * step + rule.size).cast("int").alias("prev"))

    def add(done: Column, i: Column) -> Column:
        s = (i * step).cast("int")
        length = F.least(F.lit(rule.size), n - s)
        before = F.try_element_at(done, F.lit(-1))
        grown = before["prev"] + length - rule.overlap
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(before["start"].alias("start"), F.greatest(before["end"], s + length).alias("end"), grown.alias("prev"))))
        new = F.concat(done, F.array(F.struct(s.alias("start"), (s + length).alias("end"), length.alias("prev"))))
        return F.when((F.size(done) > 0) & (grown <= most), merged).otherwise(new)

    tail = F.when(windows > full, F.sequence(full, windows - 1)).otherwise(F.array().cast("array<int>"))
    ended = F.aggregate(tail, F.when(full > 0, F.array(open_)).otherwise(none).cast(kind), lambda done, i: add(done, i).cast(kind))
    return F.concat(F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), closed)).otherwise(none).cast(kind), ended)


def chunks(units: DataFrame, rule: ChunkRule = ChunkRule(), words: str = "words") -> DataFrame:
    """The columns of units without its words, and chunk_id, start, end, words of each chunk."""
    others = [c for c in units.columns if c != words]
    cut = units.withColumn("_ranges", chunk_ranges(F.size(words), rule)).select(*others, F.col(words).alias("_words"), F.posexplode_outer("_ranges").alias("chunk_id", "_r"))
    # An inner explode would make the optimizer infer a filter on the ranges and fold them, and the words, a second time.
    cut = cut.filter(F.col("chunk_id").isNotNull())
    part = F.slice("_words", F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start"))
    return cut.select(*others, "chunk_id", F.col("_r.start").alias("start"), F.col("_r.end").alias("end"), part.alias("words"))


def concat_evidence(ranked: DataFrame, by: list[str], order: str, separator: str | None = None) -> DataFrame:
    """One context for each question: its chunks' words in rank order, with a separator between chunks that have words."""
    full = ranked.filter(F.size("words") > 0).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "words"))).alias("parts"))
    joiner = " " if separator is None else f" {separator} "
    return full.select(*by, F.array_join(F.transform("parts", lambda p: F.array_join(p["words"], " ")), joiner).alias("context"))


def within_budget(rows: DataFrame, by: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """The rows up to which the running sum of tokens stays within the budget."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(tokens).over(so_far)).filter(F.col("used") <= budget)


def surroundings(kept: DataFrame, positions: DataFrame, n: int) -> DataFrame:
    """doc_id, page_idx, pos, rank: each kept chunk grown by n places on its page; a place goes to the best rank alone.

    kept: doc_id, page_idx, rank, first, last (places of the chunk on its page's list of chunk words); positions: doc_id,
    page_idx, n_places.
    """
    grown = kept.join(positions, ["doc_id", "page_idx"])
    pos = F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - n), F.least(F.col("n_places") - 1, F.col("last") + n)))
    return grown.select("doc_id", "page_idx", "rank", pos.alias("pos")).groupBy("doc_id", "page_idx", "pos").agg(F.min("rank").alias("rank"))


def patches(pages: DataFrame, patch: int, overlap: bool = True, mode: str = "square") -> DataFrame:
    """The columns of pages (with width, height in pixels) and row, col, x0, y0, x1, y1 of its patches.

    square: patches of one side, those at the far edges shifted back inside; horizontal: strips over the whole width, the
    last one shorter; page: the whole page.
    """
    if mode == "page":
        return pages.select("*", *(F.lit(v).alias(n) for n, v in (("row", 0), ("col", 0), ("x0", 0), ("y0", 0))), F.col("width").alias("x1"), F.col("height").alias("y1"))
    step = patch - patch // 2 if overlap else patch
    count = lambda side: F.when(F.col(side) <= patch, 1).otherwise(F.ceil((F.col(side) - patch) / step).cast("int") + 1)
    rows = pages.withColumn("row", F.explode(F.sequence(F.lit(0), count("height") - 1)))
    if mode == "horizontal":
        y0 = F.col("row") * step
        return rows.select("*", F.lit(0).alias("col"), F.lit(0).alias("x0"), y0.alias("y0"), F.col("width").alias("x1"), F.least(y0 + patch, F.col("height")).alias("y1"))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), count("width") - 1)))
    x0 = F.greatest(F.lit(0), F.least(F.col("col") * step, F.col("width") - patch))
    y0 = F.greatest(F.lit(0), F.least(F.col("row") * step, F.col("height") - patch))
    return cells.select("*", x0.alias("x0"), y0.alias("y0"), F.least(x0 + patch, F.col("width")).alias("x1"), F.least(y0 + patch, F.col("height")).alias("y1"))
