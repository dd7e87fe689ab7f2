"""Spans of many strings in texts, against str.find."""

import random

import pytest

from folioscan.operators import matching


def plain(texts, strings):
    return sorted((i, s, t.find(x)) for i, t in enumerate(texts) for s, x in enumerate(strings) if x in t)


@pytest.mark.parametrize("letters", ["ab", "abcé", "a𝒳b\n"])
@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_automaton(monkeypatch, letters, stretch):
    monkeypatch.setattr(matching, "STRETCH", stretch)
    rng = random.Random(stretch)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    strings = sorted({word(rng.randrange(1, 9)) for _ in range(40)} | {"a", letters * 5})
    texts = ["", "z", *(word(rng.randrange(200)) + rng.choice(["", "zz", letters * 5]) for _ in range(30)), letters * 60]
    got = matching.Automaton(strings).first(texts)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == plain(texts, strings)
    assert [len(x) for x in matching.Automaton(["qq"]).first(["", "q"])] == [0, 0, 0]


@pytest.mark.parametrize(("block", "batch"), [(200_000, 4 << 20), (12, 50)])
def test_spans_in_blocks(spark, monkeypatch, block, batch):
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    items = [(i, word(rng.randrange(1, 30 if i % 7 else 3))) for i in range(60)] + [(60, ""), (61, None), (62, "abc"), (63, "abc")]
    docs = [(i, word(rng.randrange(300)) + rng.choice(items[:60])[1]) for i in range(50)] + [(50, None), (51, ""), (None, "abc"), (3, "cab abc")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = matching.first_spans(frame, spark.createDataFrame(items, "item_id long, text string"))
    want = sorted(((d, i, t.find(x), t.find(x) + len(x)) for d, t in docs for i, x in items if t and x and x in t), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want
    drawn = {r["doc_id"]: (r["item_id"], r["start"]) for r in matching.one_span(frame.filter("doc_id <> 3"), found, "doc_id % n").collect()}
    for d, t in docs[:52]:
        own = [(i, s) for k, i, s, _ in want if k == d and d != 3]
        if d != 3:
            assert drawn[d] == (sorted(own)[d % len(own)] if own else (-1, 0))
    empty = matching.first_spans(frame, spark.createDataFrame([], "item_id long, text string"))
    assert empty.columns == ["doc_id", "item_id", "start", "end"] and not empty.count()


def test_a_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(matching, "BATCH", 50)
    texts = ["x" * 500 + "needle" + "y" * 20 + "needle", "short needle", ""]
    groups = list(matching.pieces(texts, 5))
    found = matching.Automaton(["needle"])
    best = {}
    for group in groups:
        assert sum(len(p) for *_, p in group) <= 55
        for p, _, at in zip(*(x.tolist() for x in found.first([x[2] for x in group])), strict=True):
            best.setdefault(group[p][0], group[p][1] + at)
    assert best == {0: 500, 1: 6}


def test_texts_are_held_some_at_a_time(spark, monkeypatch):
    from folioscan.operators import matching

    monkeypatch.setattr(matching, "TEXTS", 3)
    texts = [None if i % 7 == 0 else "x" * i + "needle" * (i % 3) + "pin" * (i % 2) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "needle"), (2, "pin")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.start for r in matching.first_spans(docs, items).collect()}
    assert got == {(i, k): (t or "").find(w) for i, t in enumerate(texts) for k, w in ((1, "needle"), (2, "pin")) if w in (t or "")}
