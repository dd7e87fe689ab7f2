"""Ties that decide a result, and a second version of the language model's fit."""

import math

import numpy as np

from folioscan.llm import language, media, quality


def plain_weighed(row, idf):
    v = [math.log1p(c) * w for c, w in zip(row, idf, strict=True)]
    n = max(math.sqrt(sum(x * x for x in v)), 1e-9)
    return [x / n for x in v]


def plain_clusters(points, k, steps=12):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    first = lambda values, of: next(i for i, v in enumerate(values) if v == of(values))
    centres = [points[0]]
    while len(centres) < min(k, len(points)):
        centres.append(points[first([round(max(dot(p, c) for c in centres), 6) for p in points], min)])
    for _ in range(steps):
        near = [first([round(dot(p, c), 6) for c in centres], max) for p in points]
        for j in range(len(centres)):
            own = [p for p, n in zip(points, near, strict=True) if n == j]
            total = [sum(x) for x in zip(*own, strict=True)] if own else centres[j]
            n = max(math.sqrt(dot(total, total)), 1e-9)
            centres[j] = [x / n for x in total]
    return centres


def test_language_fit_by_plain_loops(monkeypatch):
    monkeypatch.setattr(language, "DIMENSIONS", 24)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (30, 24)) * (rng.random((30, 24)) < 0.6)
    labels = ["en" if i % 3 else "de" for i in range(30)]
    model = language.Languages(counts.astype(np.uint32), labels, k=3)
    df = (counts > 0).sum(0)
    idf = [math.log(31 / (1 + int(d))) + 0.1 for d in df]
    assert np.allclose(model.idf, idf, atol=1e-6)
    want = []
    for name in ("de", "en"):
        want += plain_clusters([plain_weighed(c, idf) for c, label in zip(counts.tolist(), labels, strict=True) if label == name], 3)
    assert model.names == ["de"] * 3 + ["en"] * 3 and np.allclose(model.centres, want, atol=1e-4)


def test_equal_languages_go_by_name():
    texts = ["some words of a text that stands in both languages", "and others of them"] * 3
    counts = np.concatenate([language.vectors(texts)] * 2)
    model = language.Languages(counts, ["zz"] * 6 + ["aa"] * 6)
    assert model.predict(texts)[0] == ["aa"] * 6


def test_a_chance_at_the_limit_is_kept(spark):
    texts = ["plain words stand here and there for all to read on " * 3, "### ## $$ x y z 1 2 3 4 5", "twelve words of no kind that say very little but are all different"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string")
    rows = quality.judge(docs).filter("NOT base_failed").collect()
    chance = rows[0]["chance"]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, chance).collect()}
    assert kept[rows[0]["doc_id"]]
    assert not {r["doc_id"]: r["kept"] for r in quality.judge(docs, math.nextafter(chance, 2)).collect()}[rows[0]["doc_id"]]


def test_energy_at_a_threshold():
    base = [0.0] * 50
    for level, loud in ((media.ON, True), (math.nextafter(media.ON, 0), False)):
        assert bool(media.stretches(np.array([*base, level, *base]))) == loud
    # A stretch goes on at the lower threshold itself, and ends below it.
    on, off = media.ON, media.OFF
    assert media.stretches(np.array([*base, on, off, math.nextafter(off, -1), off, *base])) == [(50, 52)]
