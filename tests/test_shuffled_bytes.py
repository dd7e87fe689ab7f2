"""What a query writes to disk for its shuffles stays near the bytes of its input."""

import random

import numpy as np
import pytest
from compare import TESTDATA, differences

from folioscan import catalog
from folioscan.operators import layout as L


def shuffled(spark, work):
    """Bytes that the stages of some work write for their shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    work()
    return sum(n for k, n in stages().items() if k not in before)


def test_layout_chunks(spark, tmp_path):
    """Words travel once, as texts without boxes; odd texts are cut as the SQL cuts them."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 10))) for _ in range(rng.randrange(1, 900))) for _ in range(300)]
    texts += [None, "", " \t\n", "one", "a b  c  d\r\ne", "é ü\tß " * 90, " lead and trail "]
    spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{TESTDATA}/sf0.001/embeddings.parquet").limit(200).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    (tmp_path / "one").mkdir()
    for name in ("documents", "embeddings"):  # the SQL reads single files
        spark.read.parquet(f"{tmp_path}/{name}.parquet").toPandas().to_parquet(tmp_path / "one" / f"{name}.parquet")
    query, sql = catalog.queries()["layout_chunks"], catalog.oracle_sql()["layout_chunks"]
    assert not differences(spark, query, sql, str(tmp_path / "one"))
    rows = query(spark, str(tmp_path))
    assert shuffled(spark, lambda: rows.write.format("noop").mode("overwrite").save()) < 2 * sum(len(t or "") for t in texts)


def test_words_on_a_grid(spark):
    """Words without boxes are cut as words with the boxes of the grid are; what would be torn is an error."""
    rng = random.Random(8)
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    docs = [(d, d % 3, [f"w{d}_{i}" for i in range(rng.choice([0, 1, 9, 10, 11, 57, 300]))]) for d in range(40)]
    sides = {n: L.word_grid(n).T.tolist() for n in {len(w) for _, _, w in docs} if n}
    boxes = []
    for b in range(50):
        x, y = rng.random(), rng.random()
        boxes.append((b, b % 3, (x, y, x + rng.random(), y + rng.random()), f"l{b % 4}", b % 5 - 1))
    frame = spark.createDataFrame(boxes, f"box_id long, page long, box {kind}, label string, cluster long")
    plain = spark.createDataFrame(docs, "doc_id long, page long, words array<string>")
    placed = spark.createDataFrame([(d, p, [(w, tuple(s)) for w, s in zip(ws, sides.get(len(ws), []), strict=True)]) for d, p, ws in docs], f"doc_id long, page long, words array<struct<word: string, box: {kind}>>")
    got = {(r["doc_id"], r["place"], r["chunk_id"]): (r["label"], r["start"], r["words"]) for r in L.layout_chunks(plain, frame, grid=L.word_grid).collect()}
    want = {(r["doc_id"], r["place"], r["chunk_id"]): (r["label"], r["start"], [w["word"] for w in r["words"]]) for r in L.layout_chunks(placed, frame).collect()}
    assert got == want and len(got) > 100
    assert np.allclose(L.word_grid(12)[:, 11], (0.1, 0.5, 0.2, 1.0))
    for words in (["a b", "c"], ["a", None]):
        torn = spark.createDataFrame([(1, 1, words)], "doc_id long, page long, words array<string>")
        with pytest.raises(Exception, match="without blanks"):
            L.layout_chunks(torn, frame, grid=L.word_grid).collect()
