"""Operators against plain Python that follows the rules word by word."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.functions import text as X
from folioscan.operators import chunking as C
from folioscan.operators import layout as L
from folioscan.operators import ranking as R
from folioscan.operators import sampling as S


def plain_ranges(n, size, tolerance, overlap):
    out = []
    for s in range(0, n, size - overlap):
        length = min(size, n - s)
        if out and out[-1][2] + length - overlap <= size * (1 + tolerance):
            a, b, prev = out[-1]
            out[-1] = (a, max(b, s + length), prev + length - overlap)
        else:
            out.append((s, s + length, length))
    return [(a, b) for a, b, _ in out]


@pytest.mark.parametrize("rule", [(60, 0.2, 10), (60, 0.2, 0), (60, 0.2, 50), (10, 0.5, 9), (20, 1.0, 5)])
def test_chunk_ranges(spark, rule):
    rows = spark.range(0, 260).select(F.col("id").cast("int").alias("n"))
    got = rows.select("n", C.chunk_ranges(F.col("n"), C.ChunkRule(*rule)).alias("r")).collect()
    for row in got:
        assert [(x["start"], x["end"]) for x in row["r"]] == plain_ranges(row["n"], *rule), row["n"]


def test_no_such_rule():
    with pytest.raises(ValueError):
        C.ChunkRule(10, 0.2, 10)


def test_boxes(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.5, 0.5, 2.0, 2.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    one, two = G.box(*(F.col(c) for c in "abcd")), G.box(*(F.col(c) for c in "efgh"))
    got = rows.select(G.containment(one, two).alias("c"), G.iou(one, two).alias("i"), G.overlaps(one, two).alias("o"), G.weighted_area(one).alias("w")).collect()
    assert [(r.c, round(r.i, 6), r.o) for r in got] == [(0.25, round(0.25 / 3, 6), True), (0.0, 0.0, False), (0.0, 0.0, False)]
    assert math.isclose(got[0].w, 1.0) and got[1].w == 0.0


def test_answers(spark):
    cases = [("42", "42", "int", 1.0), ("-5", "-5.9", "int", 1.0), ("42", "43", "int", 0.0), ("3.7", "3.7%", "float", 1.0), ("[b,a]", "a,b", "list", 1.0), ("x", None, "not-answerable", 1.0), ("Abc ", "abc", "string", 1.0), ("none", "None", "string", 0.0), ("a@b.co", "a@b.cx", "string", 0.0), ("4\n2", "4 2", "string", 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, gold string, pred string, kind string, want double")
    got = rows.select("i", "want", X.accuracy(F.array("gold"), F.col("pred"), F.col("kind")).alias("a")).collect()
    assert [r.a for r in sorted(got)] == [r.want for r in sorted(got)]


def test_anls_cutoffs(spark):
    rows = spark.createDataFrame([("ab", "ax"), ("abc", "abx"), ("", ""), ("abc", "")], "g string, p string")
    got = rows.select(X.anls_strict(F.col("g"), F.col("p")).alias("s"), X.anls(F.array("g"), F.col("p"), F.lit("string")).alias("a")).collect()
    assert [(round(r.s, 4), round(r.a, 4)) for r in got] == [(0.0, 0.5), (0.6667, 0.6667), (1.0, 0.0), (0.0, 0.0)]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.5, 0.5, 0.1])] + [(2, i, 0.1) for i in range(3)], "q int, c int, s double")
    kept = R.rerank(rows, ["q"], "s", ["c"], 0.4, 2, 1).collect()
    assert sorted((r.q, r.c) for r in kept) == [(1, 0), (1, 1), (2, 0)]


def plain_boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(20), rng.randrange(20)
        out.append((i % 3, i, (x / 25, y / 25, (x + 1 + rng.randrange(5)) / 25, (y + 1 + rng.randrange(5)) / 25)))
    return out


def test_suppressed_and_components(spark):
    boxes = plain_boxes(150, 4)
    table = spark.createDataFrame(boxes, "page long, box_id long, box struct<x0:double,y0:double,x1:double,y1:double>")
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    both = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    want = []
    for page in range(3):
        own = sorted(((i, b) for p, i, b in boxes if p == page), key=lambda x: (-size(x[1]), x[0]))
        kept = []
        for i, b in own:
            if all(both(b, k) / (size(b) + size(k) - both(b, k) + 1e-8) <= 0.3 for _, k in kept):
                kept.append((i, b))
        want += [(page, i) for i, _ in kept]
    assert sorted((r.page, r.box_id) for r in L.suppress(table, 0.3).collect()) == sorted(want)
    edges = {(r.page, r.a, r.b) for r in L.overlap_edges(table).collect()}
    label = {(p, i): i for p, i, _ in boxes}
    for _ in range(len(boxes)):
        for p, a, b in edges:
            label[p, a] = label[p, b] = min(label[p, a], label[p, b])
    assert {(r.page, r.box_id): r.component for r in L.components(table).collect()} == label


def test_quotas():
    assert S.quotas({1: 5, 2: 1, 3: 9}, 9) == {1: 4, 2: 1, 3: 4}
    assert S.quotas({1: 1}, 9) == {1: 1} and S.quotas({}, 3) == {}


def test_patches(spark):
    rows = spark.createDataFrame([(1, 300, 100), (2, 10, 10)], "id int, width int, height int")
    got = sorted((r.id, r.row, r.col, r.x0, r.x1, r.y1) for r in C.patches(rows, 200).collect())
    assert got == [(1, 0, 0, 0, 200, 100), (1, 0, 1, 100, 300, 100), (2, 0, 0, 0, 10, 10)]
    strips = sorted((r.id, r.row, r.y0, r.y1) for r in C.patches(rows, 64, False, "horizontal").collect())
    assert strips == [(1, 0, 0, 64), (1, 1, 64, 100), (2, 0, 0, 10)]
