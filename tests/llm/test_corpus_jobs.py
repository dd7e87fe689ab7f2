"""Corpus jobs that must not lose rows beyond the sizes of the given tables."""

import random

import corpus_pipeline

from folioscan.llm import pii
from folioscan.llm.sample import choose


def test_pii_in_long_runs():
    fill = ",".join(f"field{c}" for c in "abcdefghijklmnop")
    for text in (f"{fill},lee(at)host.com,212-555-0147,{fill}", f'{{"a":"{fill}","mail":"lee(at)host.com","tel":"212-555-0147"}}', "日本語" * 30 + "lee(at)host.com、" + "日本語" * 5 + "212-555-0147" + "日本語" * 30):
        masked = text.replace("lee(at)host.com", "<email>").replace("212-555-0147", "<phone>")
        assert len(max(text.split(), key=len)) > 64 and pii.mask(text) == masked
    name = "a" * 70
    assert pii.mask(f"write to {name}(at)host.com or call") == "write to <email> or call"
    # The address begins in the words kept behind a number.
    assert pii.mask(f"in 1999 and {name}(at)host.com or call") == "in 1999 and <email> or call"
    assert pii.mask(f"in 1999 and {'b' * 30} {'a' * 40}(at)host.com or") == f"in 1999 and {'b' * 30} <email> or"
    for text in ("9," * 50_000, "a1" * 50_000, "x(at)" * 20_000, "1 " * 50_000):
        assert pii.mask(text) == text


def test_sample_goes_on_behind_long_rows(spark):
    def chosen(long, chars=1000, count=100):
        rows = [(i, "ab"[i % 2], long.get(i, 10)) for i in range(count)]
        got = choose(spark.createDataFrame(rows, "doc_id long, label string, n long"), "label", count, chars=chars)
        return sorted(r["doc_id"] for r in got.collect())

    assert chosen({}) == list(range(100))
    for n in (990, 5000):  # too long beside the others, or by itself, whatever its rank is
        for i in (0, 1, 50, 77):
            assert chosen({i: n}) == [x for x in range(100) if x != i]
    assert chosen({3: 20}, chars=2000) == list(range(100))
    assert chosen({0: 7000, 1: 6000}, count=2) == [1]


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[2]), (3, texts[3]), (None, texts[4]), (None, texts[4]), (None, texts[5]), (None, texts[3]), (4, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # Rows of one doc_id with other texts are documents of their own; copies go, whatever their doc_id.
    assert sorted((i, texts.index(t)) for i, t in got if i is not None) == [(1, 0), (2, 1), (2, 2), (3, 3)]
    assert sorted(t for i, t in got if i is None) == sorted([texts[4], texts[5]])
