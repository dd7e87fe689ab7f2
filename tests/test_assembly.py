"""Model inputs and results against plain Python, with nulls and empty inputs."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.functions import vectors as V
from folioscan.operators import assembly as A
from folioscan.operators import layout as L
from folioscan.operators import sampling as S


@pytest.mark.parametrize("grow,n", [(0, 1), (1, 3), (2, 5), (3, 9), (4, 15), (5, 21), (6, 25), ((2, 1), 15), ((0, 0), 1)])
def test_surroundings(spark, grow, n):
    rows = spark.createDataFrame([(1, 5, 5, 11, 11), (2, 0, 0, 1, 1), (3, None, 0, 1, 1)], "grid int, row int, col int, rows int, cols int")
    got = [r["grid"] for r in A.surroundings(rows, grow).collect()]
    assert (got.count(1), got.count(2), got.count(3)) == (n, 1, 0)


def test_pad_pages(spark):
    rows = spark.createDataFrame([(1, 0, ["a"]), (2, 0, []), (2, 1, None), (2, 2, ["b"])], "doc_id long, page_idx long, words array<string>")
    got = sorted((r["doc_id"], r["page_idx"]) for r in A.pad_pages(rows, 2).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert A.pad_pages(rows.limit(0), 2).count() == 0


def test_columns(spark):
    rows = spark.createDataFrame([("abcdef", "cd", 2, 4), ("abcdef", "cd", 3, 4), ("abcdef", "cd", 2, 3), ("abcdef", "cd", 0, 2), ("abcdef", "ab", 0, 2), (None, "a", 0, 1)], "t string, x string, a int, b int")
    got = [r[0] and tuple(r[0]) for r in rows.select(A.align_span(F.col("t"), F.col("x"), F.col("a"), F.col("b"))).collect()]
    assert got == [(2, 4), (2, 4), (2, 4), None, (0, 2), None]
    sizes = spark.createDataFrame([(10, 2000), (100, 100), (1024, 512), (512, 1024), (600, 600), (0, 5)], "w int, h int")
    got = [tuple(r[0]) for r in sizes.select(A.fit_within(F.col("w"), F.col("h"))).collect()]
    assert got == [(28, 2000), (100, 100), (512, 256), (256, 512), (512, 512), (28, 28)]
    words = spark.createDataFrame([(["a", "b"], "list"), ([], "list"), (["a"], None)], "w array<string>, l string")
    assert [r[0] for r in words.select(A.label_prefix(F.col("w"), F.col("l"))).collect()] == [["list: ", "a", "b"], ["list: "], ["a"]]
    times = spark.createDataFrame([(0.9,), (3661.5,), (360_000.0,), (None,)], "s double").select(A.clock(F.col("s")).alias("t"))
    assert [r["t"] for r in times.collect()] == ["00:00:00", "01:01:01", "100:00:00", None]
    assert [r[0] for r in times.select(A.seconds(F.concat("t", F.lit(" (12.5%)")))).collect()] == [0, 3661, 360_000, None]
    assert [r[0] for r in times.limit(1).select(A.seconds(F.lit("no time"))).collect()] == [None]
    confidence = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([1000.0, 0.0], [0.0, 1000.0])], "a array<double>, b array<double>")
    assert [r[0] for r in confidence.select(V.extractive_confidence(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0]


def test_compact(spark):
    boxes = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = spark.createDataFrame([(["a", "b"], [(0.1, 0.2, 0.3, 0.4), (0.0, 0.3, 0.2, 0.5)]), ([], [])], f"w array<string>, b {boxes}")
    got = [(r[0]["text"], tuple(r[0]["box"])) for r in rows.select(A.compact(F.col("w"), F.col("b"))).collect()]
    assert got == [("a b", (0.0, 0.2, 0.3, 0.5)), ("", (0.0, 0.0, 1.0, 1.0))]


@pytest.mark.parametrize("condition", ["or", "and", "small", "overlap"])
def test_filter_boxes(spark, condition):
    made = [(0.0, 0.0, 1.0, 1.0), (0.1, 0.1, 0.2, 0.2), (0.1, 0.1, 0.7, 0.5), (0.9, 0.0, 1.2, 0.0), (2.0, 2.0, 2.1, 2.1), (2.0, 2.0, 2.0, 2.0)]
    rows = spark.createDataFrame([(1, i, *b) for i, b in enumerate(made)], "page long, box_id long, a double, b double, c double, d double")
    boxes = rows.select("page", "box_id", G.box(*(F.col(c) for c in "abcd")).alias("box"))

    def weight(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return 0 if h == 0 else w * h * (w / h)

    def inside(a, b):
        area = (a[2] - a[0]) * (a[3] - a[1])
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return 0 if area <= 0 else both / area

    small = [weight(b) < 0.02 for b in made]
    within = [any(weight(b) > weight(a) and inside(a, b) >= 0.6 for b in made) for a in made]
    drop = {"or": lambda s, o: s or o, "and": lambda s, o: s and o, "small": lambda s, o: s, "overlap": lambda s, o: o}[condition]
    want = [i for i in range(len(made)) if not drop(small[i], within[i])]
    assert sorted(r["box_id"] for r in L.filter_boxes(boxes, condition).collect()) == want
    with pytest.raises(ValueError):
        L.filter_boxes(boxes, "neither")


def test_words_of_chars(spark):
    text = ["ab  c", " ", "d"]
    rows = [(1, n, i, c, (i / 10, 0.0, (i + 1) / 10, 1.0)) for n, line in enumerate(text) for i, c in enumerate(line)]
    chars = spark.createDataFrame(rows, "page int, line int, pos int, char string, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = sorted((r["line"], r["first"], r["word"], r["box"]["x0"], r["box"]["x1"]) for r in A.words_of_chars(chars).collect())
    assert got == [(0, 0, "ab", 0.0, 0.2), (0, 4, "c", 0.4, 0.5), (2, 0, "d", 0.0, 0.1)]


def test_regions(spark):
    rows = spark.createDataFrame([(1, 300, 100, 1), (2, 300, 100, 0), (3, 300, 100, None)], "region int, width int, height int, label int")
    got = sorted((r["region"], r["x0"], r["x1"]) for r in A.divide_regions(rows, 200).collect())
    assert got == [(1, 0, 200), (1, 100, 300), (2, 0, 300), (3, 0, 300)]


def test_held_out(spark):
    pool, seeds = spark.range(10).withColumnRenamed("id", "k"), spark.createDataFrame([(0,), (2,), (None,)], "k long")
    assert [r["k"] for r in S.held_out(pool, seeds, "k", [F.col("k")], 3).collect()] == [1, 3, 4]
    results = spark.createDataFrame([(1, "a", [3, 4]), (2, None, []), (3, "c", None)], "question_id long, answer string, pages array<long>")
    assert [tuple(r) for r in A.results(results).collect()] == [(1, "a", 3), (2, None, 0), (3, "c", 0)]
