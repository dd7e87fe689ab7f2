"""Clusters, chunk scores, ranks in groups and running means against plain Python."""

import difflib
import math
import random

import numpy as np
import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from folioscan.functions import similarity
from folioscan.functions.similarity import window_ratio, window_score
from folioscan.operators import clustering as K
from folioscan.operators import sampling as S
from folioscan.streaming import metrics


def plain_ratio(text, part):
    spans = [text[i : i + len(part)] for i in range(len(text) - len(part) + 1)]
    return max((difflib.SequenceMatcher(None, part, s).ratio() for s in spans), default=0.0)


def test_window_ratio():
    rng = random.Random(5)
    for _ in range(200):
        text, part = ("".join(rng.choice("abcd") for _ in range(rng.randrange(m))) for m in (40, 9))
        assert math.isclose(window_ratio(text, part), plain_ratio(text, part)) or not part, (text, part)


@pytest.mark.parametrize("seed", range(4))
def test_window_ratio_of_long_parts(monkeypatch, seed):
    """Below and above the length from which frequent letters don't begin a block; near copies; windows in steps."""
    rng = random.Random(seed)
    monkeypatch.setattr(similarity, "STEP", [4000, 7][seed % 2])
    monkeypatch.setattr(similarity, "CELLS", [1_000_000, 40][seed // 2])
    for letters in ("ab", "abcde ", "etaoin shrdlu", "etaoinshrdlcumwfgypbvk  zqjx0123456789é𝒳"):
        for n in (1, 30, 199, 200, 260):
            part = "".join(rng.choice(letters) for _ in range(n))
            text = part[: n // 2] + "".join(rng.choice(letters) for _ in range(rng.randrange(2, n + 12))) + part[n // 2 + 1 :]
            assert window_ratio(text, part) == pytest.approx(plain_ratio(text, part)), (text, part)


def test_window_score(spark):
    rows = spark.createDataFrame([("Some Long text", "LONG"), ("some lung text", "long"), ("a", "abc"), (None, "x"), ("x", None)], "t string, p string")
    got = [r.s for r in rows.select(window_score(F.col("t"), F.col("p")).alias("s")).collect()]
    assert got == [1.0, math.log2(1.75), 0.0, 0.0, 1.0]


def test_chunk_scores(spark):
    from folioscan.plans.retrieval_queries import chunk_scores

    sf = f"{TESTDATA}/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, [w for w in __import__("re").split("[ \t\n\r]+", r.text) if w]))
    want = {}
    for conv, rows in turns.items():
        for turn, role, words in rows:
            others = [" ".join(w).lower() for _, o, w in rows if o != "user"]
            if role == "user" and others:
                part = " ".join(words).lower()
                want[conv, turn] = round(math.log2(1 + max(math.log2(1 + plain_ratio(o, part)) for o in others)), 6)
    assert {(r.doc_id, r.turn): r.chunk_score for r in chunk_scores(spark, sf).collect()} == pytest.approx(want, abs=2e-6)


def test_clusters(spark):
    rng = np.random.default_rng(3)
    spots = [(0, 0), (40, 0), (0, 40)]
    rows = [(1, 10 * s + i, (x + a, y + b, x + a + 1, y + b + 1)) for s, (x, y) in enumerate(spots) for i, (a, b) in enumerate(rng.random((8, 2)).tolist())]
    rows += [(2, 1, (0.0, 0.0, 1.0, 1.0)), (3, 1, (0.0, 0.0, 1.0, 1.0)), (3, 2, (5.0, 0.0, 6.0, 1.0))]
    table = spark.createDataFrame([(p, i, tuple(map(float, b))) for p, i, b in rows], "page long, box_id long, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = {(r.page, r.box_id): r.cluster for r in K.clusters(table, most=3).collect()}
    assert {got[1, 10 * s + i] for s in range(3) for i in range(8)} == {0, 1, 2}
    assert all(len({got[1, 10 * s + i] for i in range(8)}) == 1 for s in range(3))
    assert got[2, 1] == got[3, 1] == got[3, 2] == -1
    vectors = table.withColumn("v", F.when(F.col("box_id") % 10 < 7, F.array(F.floor(F.col("box_id") / 10) + 1.0, F.lit(1.0))))
    assert {r.cluster for r in K.clusters(vectors, "v").filter("page = 1 and box_id % 10 = 7").collect()} == {-1}
    assert K.clusters(table.limit(0)).count() == 0


def test_ways_to_count_groups():
    rng = np.random.default_rng(3)
    centres = rng.random((3, 2)) * 20
    at = np.concatenate([c + rng.random((6, 2)) / 10 for c in centres])
    boxes = np.concatenate([at, at + 0.1], 1)
    points = K.spectrum(K.affinity(boxes), 6)
    for how, tried in (("best", lambda k: K.k_means(points[:, :k], k)), ("heuristic", lambda k: K.k_means(points, k))):
        scores = {k: round(K.silhouette(points, tried(k)), 9) for k in range(2, 7)}
        k = max(scores, key=scores.get)
        got, want = K.group_boxes(boxes, most=6, how=how), K.k_means(points[:, :k], k)
        assert len(set(got)) == k and len(set(zip(got.tolist(), want.tolist(), strict=True))) == k
    with pytest.raises(ValueError):
        K.group_boxes(boxes, how="other")


def test_silhouette_of_equal_points():
    same = np.zeros((5, 2))
    assert K.silhouette(same, np.zeros(5, int)) == -1.0
    assert set(K.group_boxes(np.tile([0.0, 0.0, 1.0, 1.0], (5, 1)))) <= {-1, 0, 1, 2, 3}


def test_group_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i) for i in rng.sample(range(500), 200)]
    got = S.group_rank(spark.createDataFrame(rows, "g string, i int"), ["g"], F.floor(F.col("i") / 16), ["i"]).collect()
    want = {}
    for g in ("a", "b", None):
        want |= {(g, i): n + 1 for n, i in enumerate(sorted(i for h, i in rows if h == g))}
    assert {(r.g, r.i): r.rank for r in got} == want and len(got) == 200


def test_running_means(spark, tmp_path):
    for n, part in enumerate([[("a", 1.0), ("a", None)], [("a", 0.5), ("b", 1.0)]]):
        spark.createDataFrame(part, "k string, s double").coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema("k string, s double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    metrics.write_snapshots(metrics.running_means(stream, ["k"], ["s"]), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/out")
    last = last.filter(F.col("batch") == last.agg(F.max("batch")).first()[0]).collect()
    assert {(r.k, r.n, r.s) for r in last} == {("a", 3, 0.5), ("b", 1, 1.0)}


def test_window_ratio_of_many_texts(monkeypatch):
    """What one text has is kept while the others are read; no stretch reaches from one text into the next."""
    rng = random.Random(11)
    monkeypatch.setattr(similarity, "STEP", 300)
    for n in (2, 60, 210):
        part = "".join(rng.choice("etaoin shrdlu") for _ in range(n))
        texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(2 * n + 40))) for _ in range(6)] + [part[n // 2 :], part[: n // 2], ""]
        assert window_ratio(texts, part) == pytest.approx(max(plain_ratio(t, part) for t in texts))
        assert window_ratio([*texts, "x" + part], part) == 1.0


def test_window_ratio_takes_less_than_all_rectangles(monkeypatch):
    """Stretches side by side share their blocks: the rectangles looked at are far fewer than those of all stretches."""
    seen = []
    distinct = similarity.Shorts._distinct
    monkeypatch.setattr(similarity.Shorts, "_distinct", staticmethod(lambda r: seen.append(len(r[0])) or distinct(r)))
    rng = random.Random(3)
    part, text = ("".join(rng.choice(["th", "er", "on", "an", "re", " ", "he"]) for _ in range(n)) for n in (90, 1200))
    window_ratio(text, part)
    assert 0 < sum(seen) < 12 * (len(text) - len(part))
