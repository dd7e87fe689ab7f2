"""Retrieval and choice of answers against plain Python, plug-ins and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import models as M
from folioscan.plans import answering as A
from folioscan.sources import sinks

PAGES = [(1, 0, "the red fox sleeps. A blue bird sings.".split()), (1, 1, "rain falls on the hill.".split()), (1, 2, []), (2, 0, ["zebra"]), (3, 0, [])]
ASKED = [(10, 1, "which blue bird", 0), (11, 1, "where rain falls", 1), (12, 2, "lion", 0), (13, 3, "anything", 0), (14, 9, None, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_idx long, words array<string>")
    return spark.createDataFrame(ASKED, "question_id long, doc_id long, question string, gold_page long"), pages


def plain_best(doc, question):
    """Texts and pages of a document's chunks (one for each page here), best first."""
    rows = [(" ".join(w), p) for d, p, w in PAGES if d == doc and w]
    v = M.HashedTerms().embed([question or "", *(t for t, _ in rows)])
    sims = [round(float(v[0] @ x / (np.linalg.norm(v[0]) * np.linalg.norm(x) + 1e-8)), 6) for x in v[1:]]
    order = sorted(range(len(rows)), key=lambda i: (-sims[i], rows[i][1]))
    return [(*rows[i], sims[i]) for i in order]


@pytest.mark.parametrize("mode", A.MODES)
def test_modes(tables, mode):
    got = {r["question_id"]: ([(a["answer"], round(a["confidence"], 6)) for a in r["answers"]], r["pages"]) for r in A.answer_questions(*tables, mode=mode).collect()}
    assert set(got) == {q for q, *_ in ASKED}
    ask = lambda q, texts: [(a, round(c, 6)) for a, c in M.BestSentence().answer([q or ""] * len(texts), texts)]
    for question_id, doc, q, gold in ASKED:
        best = plain_best(doc, q)
        texts, pages = [t for t, _, _ in best], [p for _, p, _ in best]
        if mode in ("oracle", "anyconforacle"):
            own = [(" ".join(w), p) for d, p, w in PAGES if (d, p) == (doc, gold) and (w or mode == "oracle")]
            want = ask(q, [t for t, _ in own]), [p for _, p in own]
        elif mode in ("custom", "none", "whole"):  # no retrieval: a window of one page around the gold page, the first page, all pages
            own = [(" ".join(w), p) for d, p, w in PAGES if d == doc and p in {"custom": [gold], "none": [0], "whole": [0, 1, 2]}[mode]]
            want = ask(q, [" ".join(t for t, _ in own if t)] if own else []), [p for _, p in own]
        elif mode == "concat":
            want = ask(q, [" ".join(texts)] if texts else []), pages
        elif mode.startswith("maxconf"):
            given = ask(q, texts)
            want = [max(given, key=lambda x: x[1])] if given else [], pages
        elif mode.startswith("anyconf"):
            want = ask(q, texts), pages
        else:
            page = min(pages) if mode == "majorpage" and pages else pages[0] if pages else None
            want = (ask(q, [t for t, p, _ in best if p == page]), [page]) if pages else ([], [])
        assert got[question_id] == want, question_id
    with pytest.raises(ValueError):
        A.answer_questions(*tables, mode="logits")


def test_no_questions(tables):
    questions, pages = tables
    assert A.answer_questions(questions.limit(0), pages).count() == 0
    assert [r["answers"] for r in A.answer_questions(questions, pages.limit(0)).collect()] == [[]] * len(ASKED)


def test_plug_ins(spark):
    rows = spark.createDataFrame([("a b", "b c"), (None, "x"), ("", None)], "a string, b string")
    got = rows.select(M.pair_score(F.col("a"), F.col("b")).alias("s"), M.embedding(F.col("a"), lambda: M.HashedTerms(8)).alias("v")).collect()
    assert [r["s"] for r in got] == [0.5, 0.0, 0.0]
    assert [r["v"] for r in got] == M.HashedTerms(8).embed(["a b", "", ""]).tolist()


def lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [3, 4], 1.0, "x"), (2, None, [], None, "y"), (3, "c", None, 0.5, None)], "question_id long, answer string, pages array<long>, score double, kind string")
    sinks.write_results(rows, str(tmp_path / "r"))
    assert sorted((json.loads(x) for x in lines(tmp_path / "r")), key=lambda r: r["questionId"]) == [{"questionId": 1, "answer": "a", "answer_page": 3}, {"questionId": 2, "answer": None, "answer_page": 0}, {"questionId": 3, "answer": "c", "answer_page": 0}]
    sinks.write_metrics(rows, str(tmp_path / "m"), ["score"], model="lexical")
    assert [json.loads(x) for x in lines(tmp_path / "m")] == [{"model": "lexical", "n": 3, "score": 0.5}]
    sinks.write_report(rows, str(tmp_path / "t"), "score", {"kind": F.array("kind"), "page": F.col("pages")})
    assert lines(tmp_path / "t") == ["kind | - | n = 1 | mean = 0.5000", "kind | x | n = 1 | mean = 1.0000", "kind | y | n = 1 | mean = 0.0000", "page | 3 | n = 1 | mean = 1.0000", "page | 4 | n = 1 | mean = 1.0000"]
    sinks.write_pairs(spark.createDataFrame([("a", "b"), ("c", None)], "anchor string, positive string"), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.columns == ["id", "anchor", "positive"] and back.select("id").distinct().count() == 2


def test_retrieve_over_blocks_of_pages(spark):
    """The best chunks of all blocks of a document's pages, in the order of the cosine; no pair of question and chunk is a row."""
    import random

    import numpy as np
    from folioscan.operators import chunking as C
    from folioscan.operators import models as M
    from folioscan.plans import answering as A

    rng = random.Random(2)
    say = lambda n: [rng.choice("red green blue one two three four five".split()) for _ in range(n)]
    held = [(d, p, say(rng.randrange(1, 9))) for d in (1, 2) for p in range(90)]
    asked = [(f"{d}:{i}", d, " ".join(say(3))) for d in (1, 2, 3) for i in range(4)]
    found = A.retrieve(spark.createDataFrame(asked, "question_id string, doc_id long, question string"), spark.createDataFrame(held, "doc_id long, page_idx long, words array<string>"), 5, C.ChunkRule(), M.HashedTerms)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "MapInArrow" in plan
    got = {(r.question_id, r.rank): (r.page_idx, r.words, round(r.sim, 9)) for r in found.collect()}
    embed = M.HashedTerms().embed
    want = {}
    for name, d, text in asked:
        q = embed([text])[0]
        own = [(float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v) + 1e-8)), p, w) for e, p, w in held if e == d for v in (embed([" ".join(w)])[0],)]
        for rank, (sim, p, w) in enumerate(sorted(own, key=lambda x: (-x[0], x[1]))[:5], 1):
            want[name, rank] = (p, w, round(sim, 9))
    assert got == want
