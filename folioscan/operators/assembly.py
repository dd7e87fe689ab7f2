"""Parts of model inputs: padding, labels before words, words of characters, boxes of chunks, sizes and neighbours of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.operators import chunking as C


def pad_pages(pages: DataFrame, n: int) -> DataFrame:
    """doc_id, page_idx, words: every document's pages and blank ones behind them, up to n; longer documents stay as they are."""
    held = pages.groupBy("doc_id").agg(F.count("*").alias("held"), F.max("page_idx").alias("last")).filter(F.col("held") < n)
    extra = F.explode(F.sequence(F.lit(1).cast("long"), n - F.col("held")))
    blank = held.select("doc_id", "last", extra.alias("k")).select("doc_id", (F.col("last") + F.col("k")).alias("page_idx"), F.array(F.lit("")).alias("words"))
    return pages.select("doc_id", "page_idx", "words").unionByName(blank)


def label_prefix(words: Column, label: Column) -> Column:
    """The words with their layout label before them; no label, no prefix."""
    return F.when(label.isNull(), words).otherwise(F.concat(F.array(F.concat(label, F.lit(": "))), words))


def compact(words: Column, boxes: Column) -> Column:
    """A chunk's text and the smallest box around its words; the whole page for a chunk without words."""
    return F.struct(F.array_join(words, " ").alias("text"), G.union(boxes).alias("box"))


def align_span(text: Column, answer: Column, start: Column, end: Column) -> Column:
    """(start, end) at which the text holds the answer: as given, or with either end one place further out; else null."""
    found = None
    for a, b in ((start, end), (start - 1, end), (start, end + 1)):
        hit = (a >= 0) & (F.substring(text, a + 1, b - a) == answer)
        pair = F.struct(a.alias("start"), b.alias("end"))
        found = F.when(hit, pair) if found is None else found.when(hit, pair)
    return found


def fit_within(width: Column, height: Column, least: int = 28, most: int = 512) -> Column:
    """(width, height) of an image after its resizing: grown to `least` on short sides, else shrunk to `most` in proportion."""
    aspect = F.try_divide(width, height)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    wide, tall = size(F.lit(most), F.try_divide(F.lit(most), aspect)), size(most * aspect, F.lit(most))
    small, large = (width < least) | (height < least), (width > most) | (height > most)
    grown = size(F.greatest(width, F.lit(least)), F.greatest(height, F.lit(least)))
    return F.when(small, grown).when(large & (aspect > 1), wide).when(large, tall).otherwise(size(width, height))


def surroundings(centres: DataFrame, grow: int | tuple[int, int]) -> DataFrame:
    """grid, row, col: the patches around each centre that lie in its grid, each once.

    centres: grid, row, col, rows, cols. grow: a radius to either side and one up and down, or a step count: every three
    steps widen a square by one, first to the sides, then up and down, then in the corners.
    """
    if isinstance(grow, tuple):
        across, down = grow
        near = [(r, c) for r in range(-down, down + 1) for c in range(-across, across + 1)]
    else:
        full, step = divmod(grow, 3)
        reach = range(-full - 1, full + 2)
        near = [(r, c) for r in reach for c in reach if max(abs(r), abs(c)) <= full or (step and abs(r) <= full) or (step == 2 and abs(c) <= full)]
    # A grid's centres come together before they are grown: what they grow to is made distinct grid by grid, not in one table.
    offsets = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in near))
    held = centres.groupBy("grid").agg(F.collect_set(F.struct("row", "col", "rows", "cols")).alias("c"))
    patch = lambda c, o: F.struct((c["row"] + o["r"]).alias("row"), (c["col"] + o["c"]).alias("col"), c["rows"].alias("rows"), c["cols"].alias("cols"))
    inside = lambda p: (p["row"] >= 0) & (p["row"] < p["rows"]) & (p["col"] >= 0) & (p["col"] < p["cols"])
    grown = F.flatten(F.transform("c", lambda c: F.filter(F.transform(offsets, lambda o: patch(c, o)), inside)))
    places = F.array_distinct(F.transform(grown, lambda p: F.struct(p["row"].alias("row"), p["col"].alias("col"))))
    return held.select("grid", F.explode(places).alias("p")).select("grid", "p.row", "p.col")


def divide_regions(regions: DataFrame, patch: int, text_label: int = 1) -> DataFrame:
    """The columns of regions and row, col, x0, y0, x1, y1: regions of the text label are cut in patches, others stay whole."""
    text = F.col("label") == text_label
    cut = C.patches(regions.filter(text), patch)
    return cut.unionByName(C.patches(regions.filter(~F.coalesce(text, F.lit(False))), patch, mode="page"))


def page_boxes(pages: DataFrame, side: int = 14, scale: float = 1.0) -> DataFrame:
    """The columns of pages with place and box: the whole page at place 0, then a grid of side by side cells, row by row."""
    cell = lambda v: v * scale / side
    rows = pages.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(side * side))))
    x, y = (F.col("place") - 1) % side, F.floor((F.col("place") - 1) / side)
    whole = G.box(F.lit(0.0), F.lit(0.0), F.lit(scale), F.lit(scale))
    return rows.withColumn("box", F.when(F.col("place") == 0, whole).otherwise(G.box(cell(x), cell(y), cell(x + 1), cell(y + 1))))


def words_of_chars(chars: DataFrame) -> DataFrame:
    """page, line, first, word, box: the runs of characters between blanks of each line. chars: page, line, pos, char, box."""
    so_far = Window.partitionBy("page", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.col("char").rlike(r"\A\s*\z")
    runs = chars.withColumn("run", F.sum(blank.cast("int")).over(so_far)).filter(~blank)
    held = runs.groupBy("page", "line", "run").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "char", "box"))).alias("c"))
    return held.select("page", "line", "first", F.array_join("c.char", "").alias("word"), G.union(F.col("c.box")).alias("box"))


def examples(rows: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The n first keys of each group as an array; groups are cut before they are collected."""
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(key))).filter(F.col("_rank") <= n)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("examples"))


def drop_unanswerable(answer: Column, confidence: Column, chance: Column) -> tuple[Column, Column]:
    """Answer and confidence, emptied where the chance that there is no answer is over one half."""
    none = F.coalesce(chance > 0.5, F.lit(False))
    return F.when(none, "").otherwise(answer), F.when(none, 0.0).otherwise(confidence)


def results(rows: DataFrame) -> DataFrame:
    """questionId, answer, answer_page (the first page, 0 without one). rows: question_id, answer, pages."""
    page = F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(0))
    return rows.select(F.col("question_id").alias("questionId"), "answer", page.cast("long").alias("answer_page"))


def clock(seconds: Column) -> Column:
    """Seconds as hh:mm:ss, parts of a second cut off; null for null."""
    s = seconds.cast("long")
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def seconds(text: Column) -> Column:
    """The seconds of a hh:mm:ss text; a share in parentheses behind it is left out. Null for another text."""
    parts = F.split(F.regexp_replace(text, r"\s*\(.*\)\s*\z", ""), ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 60 + F.trim(p).try_cast("long"))
