"""The blocked search against all pairs, with ties, equal vectors, nulls and blocks of a few rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import search


@pytest.fixture
def vectors():
    rng = random.Random(3)
    rows = [(i, i % 4, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(150)]
    rows += [(200 + i, 5, [1.0, 2.0, 0.5]) for i in range(70)]  # a third of all are equal
    return [*rows, (300, 1, None), (301, 2, [0.0, 0.0, 0.0])]


def sim(x, y):
    dot = sum(a * b for a, b in zip(x, y, strict=True))
    return round(dot / (math.hypot(*x) * math.hypot(*y) + 1e-8), 9)


@pytest.mark.parametrize(("least", "cells"), [(500, 4_000_000), (20, 10)])
def test_search(spark, monkeypatch, vectors, least, cells):
    monkeypatch.setattr(search, "LEAST", least)
    monkeypatch.setattr(search, "CELLS", cells)
    e = spark.createDataFrame(vectors, "id long, part long, vector array<float>").repartition(3)
    queries = [(i, p, v) for i, p, v in vectors if i % 10 == 0]
    asked = e.filter("id % 10 = 0").select("id", "vector")
    for k in (1, 7, 500):
        want = set()
        for i, _, v in queries:
            if v is not None:
                others = sorted((-sim(v, x), j) for j, _, x in vectors if j != i and x is not None)
                want |= {(i, j, round(-s, 6) + 0.0, r + 1) for r, (s, j) in enumerate(others[:k])}
        got = search.nearest(asked, e.select("id", "vector"), k).collect()
        assert {(r["question"], r["chunk"], round(r["sim"], 6) + 0.0, r["rank"]) for r in got} == want and len(got) == len(want)
    best = {}
    for i, _, v in queries:
        for _, p, x in vectors:
            if v is not None and x is not None:
                best[i, p] = max(best.get((i, p), -2), sim(v, x))
    got = {(r["question"], r["part"]): r["sim"] for r in search.best_of_parts(asked, e).collect()}
    assert got.keys() == best.keys() and all(abs(got[x] - best[x]) < 2e-9 for x in best)
    assert search.nearest(asked, e.filter("id < 0").select("id", "vector"), 3).count() == 0


def test_a_task_holds_little(spark):
    """Similarities and the block of a task stay small, whatever the corpus, and blocks are as many as that takes."""
    assert search.CELLS * 8 * 2 <= 10 << 20 and search.MOST * 64 * 8 <= 16 << 20
    rows = spark.range(60_000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3), F.sin(F.col("id") * 7)).alias("vector"))
    found = search.nearest(rows.filter("id % 20000 = 7"), rows, 3)
    assert "+- MapInArrow" in found._jdf.queryExecution().toString()
    v = np.array([[math.sin(i), math.cos(i * 3), math.sin(i * 7)] for i in range(60_000)])
    got = {(r.question, r["rank"]): round(r.sim, 8) for r in found.collect()}
    for q in (7, 20_007, 40_007):
        sims = v @ v[q] / (np.sqrt((v**2).sum(1)) * np.sqrt(v[q] @ v[q]) + 1e-8)
        sims[q] = -2
        assert [got[q, r] for r in (1, 2, 3)] == pytest.approx(np.sort(sims)[::-1][:3].tolist(), abs=2e-8)
