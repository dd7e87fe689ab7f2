"""Functions whose time grows with their input, not with its square, and give what plain loops give."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import vectors as V
from folioscan.operators import assembly as A
from folioscan.operators import clustering as K
from folioscan.operators import layout as L


def seconds(frame):
    best = 1e9
    for _ in range(3):
        began = time.time()
        frame.write.format("noop").mode("overwrite").save()
        best = min(best, time.time() - began)
    return best


@pytest.mark.parametrize("make", [lambda x: V.likeliest(x), lambda x: F.array_max(V.unit(x)), lambda x: V.max_sim(F.array(x, x), F.array(x, x, x))])
def test_long_vectors(spark, make):
    def rows(n):
        held = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i + F.col("id")))
        return spark.range(4).repartition(1).select(make(held).alias("v"))

    small, large = seconds(rows(10_000)), seconds(rows(80_000))
    assert large < 24 * small + 1  # 64 times with the square


def test_values(spark):
    x = [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], [-3.0, 4.0, 0.0]]
    row = spark.createDataFrame([(x,)], "x array<array<double>>").select(F.transform("x", V.unit).alias("u"), F.transform("x", V.likeliest).alias("l"), V.max_sim(F.col("x"), F.slice("x", 1, 2)).alias("m")).first()
    unit = lambda v: [a / (math.hypot(*v) or 1) for a in v]
    assert all(list(a) == pytest.approx(unit(b)) for a, b in zip(row["u"], x, strict=True))
    assert row["l"] == pytest.approx([math.exp(max(v)) / sum(map(math.exp, v)) for v in x])
    assert row["m"] == pytest.approx(sum(max(sum(a * b for a, b in zip(unit(q), unit(p), strict=True)) for p in x[:2]) for q in x))


def test_split_by_budget(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 0, 3, 20, 70, 200])) for g in range(5) for i in range(0, 400, 1 + g)] + [(9, i, 7) for i in range(60_000)]
    frame = spark.createDataFrame(rows, "g long, i long, n int").repartition(4)
    got = {(r["g"], r["i"]): r["part"] for r in K.split_by_budget(frame, ["g"], "i", "n", 100).collect()}
    group, part, used = None, 0, 0
    for g, i, n in rows:
        if g != group:
            group, part, used = g, 0, 0
        if used > 0 and used + (n or 0) > 100:
            part, used = part + 1, 0
        used += n or 0
        assert got[g, i] == part
    assert len(got) == len(rows)


def test_suppress(spark):
    rng = random.Random(2)
    boxes = [(b, p, (x := rng.random(), y := rng.random(), x + rng.random() / 3, y + rng.random() / 3)) for p in range(3) for b in range(120)]
    frame = spark.createDataFrame([(p, b, box) for b, p, box in boxes], "page long, box_id long, box struct<x0: double, y0: double, x1: double, y1: double>")
    got = {(r["page"], r["box_id"]) for r in L.suppress(frame, 0.3).collect()}

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + 1e-8)

    want = set()
    for page in range(3):
        kept = []
        for b, _, box in sorted((x for x in boxes if x[1] == page), key=lambda x: (-(x[2][2] - x[2][0]) * (x[2][3] - x[2][1]), x[0])):
            if all(iou(box, k) <= 0.3 for k in kept):
                kept.append(box)
                want.add((page, b))
    assert got == want


def test_surroundings_grow_grid_by_grid(spark):
    """Patches are made distinct within a grid, so no table holds all of them."""
    rng = random.Random(4)
    centres = [(g, rng.randrange(4), rng.randrange(5), 4, 5) for g in range(30) for _ in range(rng.randrange(1, 9))]
    grown = A.surroundings(spark.createDataFrame(centres, "grid long, row int, col int, rows int, cols int"), (1, 2))
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the plan is told from its end
    want = {(g, r + i, c + j) for g, r, c, n, m in centres for i in range(-2, 3) for j in range(-1, 2) if 0 <= r + i < n and 0 <= c + j < m}
    rows = [tuple(r) for r in grown.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_images_of_one_name(spark):
    """The images of one name are dealt to many tasks."""
    images = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("img"), F.floor(F.col("id") / 399)).alias("image_name"))
    boxes = spark.createDataFrame([("img0", b) for b in range(7)] + [("img2", 9)], "image_name string, box_id long")
    rows = L.boxes_of_images(images, boxes, "image_name", F.col("page_id")).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["page_id"], r["box_id"]) for r in rows} == {(i, b) for i in range(399) for b in range(7)} and len(rows) == 399 * 7
    assert len({r["task"] for r in rows}) > 4


def test_edges_by_blocks(spark, monkeypatch):
    rng = random.Random(6)
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    nodes = [(p, b, (rng.random(), rng.random(), rng.random() + 1, rng.random() + 1), [rng.gauss(0, 1) for _ in range(4)] if b % 7 else None) for p in range(3) for b in range(p * 100, p * 100 + 40 - p * 15)]
    monkeypatch.setattr(L, "BLOCK", 8)
    frame = spark.createDataFrame(nodes, f"page long, box_id long, box {kind}, v array<double>")
    rows = {(r["page"], r["a"], r["b"]): r["weight"] for r in L.edges(frame, "v").collect()}
    held = [(p, b, x, [c / math.hypot(*v) for c in v]) for p, b, x, v in nodes if v]
    near = lambda x, y: 1 / (1 + math.hypot((x[0] + x[2] - y[0] - y[2]) / 2, (x[1] + x[3] - y[1] - y[3]) / 2))
    want = {(p, a, b): (near(x, y) + sum(map(float.__mul__, u, v))) / 2 for p, a, x, u in held for q, b, y, v in held if p == q and a < b}
    assert rows == pytest.approx(want) and len(rows) == len(want)


def test_spectrum_of_many_boxes(monkeypatch):
    """The spectrum and the groups are those of the whole matrix, of which only some rows are held."""
    rng = np.random.default_rng(3)
    corner = rng.random((500, 2))
    boxes, vectors = np.concatenate([corner, corner + rng.random((500, 2)) / 4], 1), rng.standard_normal((500, 16))
    for v in (None, vectors):
        assert np.abs(K.far_spectrum(boxes, v, 10) - K.spectrum(K.affinity(boxes, v), 10)).max() < 1e-8
    whole = K.group_boxes(boxes)
    monkeypatch.setattr(K, "WHOLE", 100)
    assert (K.group_boxes(boxes) == whole).all()
