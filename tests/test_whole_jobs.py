"""Jobs that must not lose rows beyond the sizes of the given tables."""

import time
from statistics import mean, pstdev

from pyspark.sql import functions as F

from folioscan import catalog
from folioscan.operators import chunking as C


def test_noise_bins_of_long_conversations(spark, tmp_path):
    turns = {1: 12, 2: 12, 3: 2, 4: 15}
    rows = [(c, t, "user", "a b") for c, n in turns.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["level"], r["n"]): (r["mean"], r["std"]) for r in catalog.queries()["noise_bins"](spark, str(tmp_path)).collect()}
    want = {}
    for level in (0, 3, 20, 100):
        scores = {c: [(c * 17 + level * 5 + rep * 31) % 101 / 100 for rep in range(3)] for c in turns}
        for n in range(1, 16):
            own = [scores[c] for c in turns if turns[c] == n]
            want[level, n] = (round(mean(map(mean, own)), 6), round(mean(map(pstdev, own)), 6)) if own else (0.0, 0.0)
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 2e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_spans_of_short_items(spark, tmp_path):
    """Items of any length are found where they stand first, in the middle of words too, and copies of one text alike."""
    items = [(0, "one two three four five six seven"), (1, "lone"), (2, "a b"), (3, ""), (4, "x two three four five six y z")]
    docs = [(0, "zero one two three four five six seven, lone"), (1, "alone"), (2, "a  b and a b"), (3, ""), (4, None), (5, "prex two three four five six y zed"), (6, "one two  three four five six seven")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["item_id"], r["span_start"], r["span_end"]) for r in catalog.queries()["answer_span"](spark, str(tmp_path)).collect()}
    want = {}
    for doc_id, text in docs:
        hits = [(text.find(t), i, text.find(t) + len(t)) for i, t in items if text and t and t in text]
        want[doc_id] = (lambda h: (h[1], h[0], h[2]))(min(hits)) if hits else (-1, 0, 0)
    assert got == want


def test_pairs_of_near_turns(spark, tmp_path):
    rows = [(1, 0, "user", "what is the red house made of"), (1, 1, "assistant", "What is the red house made of?"), (1, 2, "user", "what is the red house made for"), (1, 3, "system", "something else"), (2, 0, "user", "what is the red house made of")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["anchor"], r["positive"]) for r in catalog.queries()["contrastive_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 1), (1, 0, 2), (1, 2, 0), (1, 2, 1)}


def test_a_long_document_is_chunked_in_seconds(spark):
    words = spark.range(1).select(F.lit(1).alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: i.cast("string")).alias("words"))
    began = time.time()
    row = C.chunks(words).agg(F.count("*").alias("n"), F.max("end").alias("last"), F.sum(F.size("words")).alias("held")).first()
    assert (row["n"], row["last"]) == (20_000, 1_000_000) and row["held"] >= 1_000_000 and time.time() - began < 60
