"""What a model is given: questions with their pages, prompts, image sizes, patches in rows, pasted patches, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import bind

# The classes of two layout models, and the four that they are mapped to (0 title, 1 text, 2 figure, 3 table).
LABELS_OF_TWELVE: dict[int, int | None] = {0: None, 1: 1, 2: 1, 3: None, 4: 3, 5: 1, 6: 1, 7: 2, 8: 0, 9: 3, 10: 1, 11: 0}
LABELS_OF_TEN: dict[int, int | None] = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3, 8: None, 9: None}

# The prompts of three generators.
TEXT_PROMPT = "question: %s  context: "
PAGE_PROMPT = "%s: question: %s  context: %s"
CHAT_PROMPT = "question: %s\nDirectly provide only a short direct answer to the question. The answer appears in the following context.Context: %s"


def explode_questions(documents: DataFrame, pick: Column, train: bool = False) -> DataFrame:
    """The columns of documents without its questions, and a row for each question: question_id, question, answers, answer_type.

    documents has questions, an array of structs with these fields. In training a row has `label` instead of its answers: the
    one at `pick` modulo their number; pick may use question_id.
    """
    others = [c for c in documents.columns if c != "questions"]
    rows = documents.select(*others, F.explode("questions").alias("q")).select(*others, "q.*")
    if not train:
        return rows
    label = F.when(F.size("answers") > 0, F.try_element_at("answers", (F.pmod(pick, F.greatest(F.size("answers"), F.lit(1))) + 1).cast("int")))
    return rows.withColumn("label", label).drop("answers")


def prompts(question: Column, context: Column, page_tokens: int = 10) -> Column:
    """text, page and chat: the question and context as the three generators are given them."""
    marks = "".join(f"[PAGE_{i}]" for i in range(page_tokens))
    return F.struct(F.concat(F.format_string(TEXT_PROMPT, question), context).alias("text"), F.format_string(PAGE_PROMPT, F.lit(marks), question, context).alias("page"), F.format_string(CHAT_PROMPT, question, context).alias("chat"))


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def longest_side(width: Column, height: Column, side: int = 1024) -> Column:
    """The size whose longer side is `side`, in proportion, cut off to whole pixels."""
    return bind(F.lit(float(side)) / F.greatest(width, height), lambda s: _size(width * s, height * s))


def shortest_side(width: Column, height: Column, side: int) -> Column:
    """The size whose shorter side is `side`; the longer one is rounded up."""
    tall = _size(F.lit(side), F.ceil(height / width * side))
    return F.when(width < height, tall).otherwise(_size(F.ceil(width / height * side), F.lit(side)))


def by_ratio(width: Column, height: Column, ratio: float) -> Column:
    return _size(F.ceil(width * ratio), F.ceil(height * ratio))


def to_multiple(width: Column, height: Column, of: int) -> Column:
    """The size rounded up to multiples."""
    return _size(F.ceil(width / of) * of, F.ceil(height / of) * of)


def tiles(images: DataFrame, side: int) -> DataFrame:
    """The columns of images (with width, height) and left, top, right, bottom of tiles of one side; those at the edges reach over them."""
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(side)))
    rows = images.filter("width > 0 AND height > 0").withColumn("top", starts("height")).withColumn("left", starts("width"))
    return rows.withColumns({"right": F.col("left") + side, "bottom": F.col("top") + side})


def patch_grid(width: Column, height: Column, patch: int, most: Column) -> Column:
    """rows and cols of the patches that an image is scaled to, so that they are about `most` in all."""
    scale = F.sqrt(most * (F.lit(float(patch)) / height) * (F.lit(float(patch)) / width))
    fit = lambda s, n: F.greatest(F.least(F.floor(s * n / patch), most), F.lit(1)).cast("long")
    return bind(scale, lambda s: F.struct(fit(s, height).alias("rows"), fit(s, width).alias("cols")))


def flattened_patches(images: DataFrame, by: str, order: str, patch: int, most: int) -> DataFrame:
    """by, place, order, row, col: the patches of a group's images one after the other, rows numbered through from 1.

    Each image may have an equal part of `most`. Patches beyond `most` are left out, and places that are left get row and col
    0, as a model's input has one size.
    """
    group = Window.partitionBy(by)
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    share = images.withColumn("part", F.floor(F.lit(most) / F.count("*").over(group)))
    sized = share.withColumn("g", patch_grid(F.col("width"), F.col("height"), patch, F.col("part"))).select(by, order, "g.*", "part")
    # A group's part may be nothing; an image still has its one patch.
    placed = sized.withColumns({"above": F.coalesce(F.sum("rows").over(before), F.lit(0)), "first": F.coalesce(F.sum(F.col("rows") * F.col("cols")).over(before), F.lit(0))})
    cells = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("cols") - 1)).alias("i"))
    held = cells.select(by, (F.col("first") + F.col("i")).alias("place"), order, (F.col("above") + F.floor(F.col("i") / F.col("cols")) + 1).alias("row"), (F.col("i") % F.col("cols") + 1).alias("col"))
    total = placed.groupBy(by).agg(F.sum(F.col("rows") * F.col("cols")).alias("n")).filter(F.col("n") < most)
    padded = total.select(by, F.explode(F.sequence("n", F.lit(most - 1).cast("long"))).alias("place"), F.lit(None).cast(dict(images.dtypes)[order]).alias(order), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"))
    return held.filter(F.col("place") < most).unionByName(padded)


def pasted(sizes: Column, mode: str = "grid") -> Column:
    """width and height of the image that patches (an array of width, height) are pasted into, and each patch's x and y.

    horizontal and vertical: one behind the other. grid: in rows of the widest patch's width, in the order given; the height is
    what the patches' area needs. Without patches the image is 5 by 5.
    """
    if mode not in ("horizontal", "vertical", "grid"):
        raise ValueError(f"no such mode: {mode}")
    zero = F.lit(0).cast("long")
    side = lambda f: F.transform(sizes, lambda s: s[f].cast("long"))
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    widest, tallest = F.array_max(side("width")), F.array_max(side("height"))
    across = widest if mode != "horizontal" else total(side("width"))
    down = {"horizontal": tallest, "vertical": total(side("height")), "grid": F.floor(total(F.transform(sizes, lambda s: s["width"].cast("long") * s["height"])) / widest)}[mode]
    state = "struct<x:bigint,y:bigint,row:bigint,at:array<struct<x:bigint,y:bigint>>>"
    start = F.struct(zero.alias("x"), zero.alias("y"), zero.alias("row"), F.array().cast("array<struct<x:bigint,y:bigint>>").alias("at")).cast(state)

    def put(s: Column, p: Column) -> Column:
        new = (s["x"] + p["width"] > across) if mode == "grid" else F.lit(mode == "vertical") & (F.size(s["at"]) > 0)
        x, y = F.when(new, zero).otherwise(s["x"]), F.when(new, s["y"] + s["row"]).otherwise(s["y"])
        row = F.greatest(F.when(new, zero).otherwise(s["row"]), p["height"].cast("long"))
        return F.struct((x + p["width"]).alias("x"), y.alias("y"), row.alias("row"), F.concat(s["at"], F.array(F.struct(x.alias("x"), y.alias("y")))).alias("at")).cast(state)

    found = F.struct(across.cast("long").alias("width"), down.cast("long").alias("height"), F.aggregate(sizes, start, put, lambda s: s["at"]).alias("at"))
    blank = F.struct(F.lit(5).cast("long").alias("width"), F.lit(5).cast("long").alias("height"), F.array().cast("array<struct<x:bigint,y:bigint>>").alias("at"))
    return F.when(F.size(sizes) > 0, found).otherwise(blank)


def within_tokens(words: Column, prompt_tokens: int | Column, most: int, end: str = "</s>") -> Column:
    """The words that fit behind a prompt before the last place, and the end token in it."""
    room = F.greatest(F.lit(0), F.lit(most - 1) - prompt_tokens).cast("int")
    return F.concat(F.slice(words, 1, room), F.array(F.lit(end)))


def page_inputs(pages: DataFrame, page_tokens: int, prompt: int, most: int) -> DataFrame:
    """The columns of pages without words, and place, kind, box of each token of a page's input: page tokens, prompt, words, end.

    pages: words, an array of struct (word, box). Boxes are scaled to 1000; those of page tokens and prompt are the whole page,
    the end's is empty. Words that don't fit in `most` tokens are left out; a page without words has an empty box for them.
    """
    others = [c for c in pages.columns if c != "words"]
    whole = F.struct(*(F.lit(float(v)).alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 1000), ("y1", 1000))))
    none = F.struct(*(F.lit(0.0).alias(n) for n in ("x0", "y0", "x1", "y1")))
    scaled = F.transform("words", lambda w: F.struct(*((w["box"][n].cast("double") * 1000).alias(n) for n in ("x0", "y0", "x1", "y1"))))
    kinds = [("page", F.array_repeat(whole, page_tokens)), ("prompt", F.array_repeat(whole, prompt)), ("word", F.when(F.size("words") > 0, F.slice(scaled, 1, most - page_tokens - prompt - 1)).otherwise(F.array(none))), ("end", F.array(none))]

    def named(kind: str, boxes: Column) -> Column:
        return F.transform(boxes, lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("box")))

    every = F.concat(*(named(*k) for k in kinds))
    return pages.select(*others, F.posexplode(every).alias("place", "t")).select(*others, "place", "t.kind", "t.box")


def normalised(values: Column) -> Column:
    """An image's values less their mean, over their deviation, which counts as 1 / sqrt(how many) at least."""
    numbers = F.transform(values, lambda v: v.cast("double"))
    n = F.size(values)
    mean = F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v) / n

    def scaled(v: Column, m: Column) -> Column:
        spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n)
        return bind(F.greatest(spread, 1 / F.sqrt(n)), lambda d: F.transform(v, lambda x: (x - m) / d))

    return bind(mean, lambda m: scaled(numbers, m))


def document_id(question_id: Column, tokens: Column) -> Column:
    """The question's id, else a hash of the first page's first five tokens, else one of no tokens."""
    first = F.coalesce(F.array_join(F.slice(tokens, 1, 5), " "), F.lit(""))
    return F.coalesce(question_id.cast("string"), F.md5(first.cast("binary")))


def flattened(chunks: Column, between: Column) -> Column:
    """The chunks (an array of arrays) one after the other, with `between` before every one that isn't empty but the first."""
    parts = F.transform(chunks, lambda c, i: F.when((i > 0) & (F.size(c) > 0), F.concat(F.array(between), c)).otherwise(c))
    return F.flatten(parts)
