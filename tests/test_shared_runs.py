"""The runs of a noise experiment share what they have in common, and find what each of them finds alone."""

import numpy as np
import pyarrow as pa
import pytest
import test_experiment as plain

from folioscan.operators import models as M
from folioscan.plans import experiment as E
from folioscan.plans.answering import Rerank

LEVELS, REPS, SEED, K = (2, 0, 6), 2, 5, 3


def logged(path):
    """A maker of a model that tells a file of the texts that it is given."""

    class Logged:  # within a function, so that it travels to the workers
        def embed(self, texts):
            self.log(texts)
            return M.HashedTerms().embed(texts)

        def answer(self, questions, contexts):
            self.log(f"{q}|{c}" for q, c in zip(questions, contexts, strict=True))
            return M.BestSentence().answer(questions, contexts)

        def log(self, lines):
            with open(path, "a") as out:
                out.writelines(x + "\n" for x in lines)

    return Logged


def frames(spark):
    pages = spark.createDataFrame(plain.PAGES, "doc_id long, page_idx long, words array<string>").repartition(3)
    return spark.createDataFrame(plain.ASKED, "question_id string, doc_id long, question string, gold_page long, golds array<string>"), pages


def rows(scores):
    return sorted((r["level"], r["rep"], r["question_id"], r["n_pages"], round(r["anls"], 6), r["accuracy"], r["precision"]) for r in scores.collect())


@pytest.mark.parametrize("mode", ["maxconf", "anyconf"])
def test_shared_and_alone(spark, tmp_path, monkeypatch, mode):
    asked, pages = frames(spark)
    embedded, answered = f"{tmp_path}/embedded", f"{tmp_path}/answered"
    got = rows(E.noise_experiment(asked, pages, LEVELS, REPS, seed=SEED, k=K, mode=mode, embedder=logged(embedded), answerer=logged(answered)))
    class Equal:  # lets all chunks pass as they are, in runs that share nothing
        def score(self, pairs):
            return [1.0] * len(pairs)

    alone = rows(E.noise_experiment(asked, pages, LEVELS, REPS, seed=SEED, k=K, mode=mode, rerank=Rerank(Equal, most=K)))
    assert got == alone and len(got) == len(plain.ASKED) * len(LEVELS) * REPS and len({r[4:] for r in got}) > 1
    n_docs = len({p[0] for p in plain.PAGES})
    lines = open(embedded).read().splitlines()
    assert len(lines) <= len(plain.ASKED) + len(plain.PAGES) + n_docs * max(LEVELS) * REPS
    pairs = open(answered).read().splitlines()
    assert len(pairs) < len(got) * K * 0.7  # level 0 is answered once, not for each repetition
    monkeypatch.setattr(E, "ASKED", 1)
    assert rows(E.noise_experiment(asked, pages, LEVELS, REPS, seed=SEED, k=K, mode=mode)) == got


def test_odd_rows(spark):
    """Pages without words count as pages; questions without a gold page of their document fall out, those without chunks stay."""
    words = [(1, 0, []), (1, 1, None), (2, 0, ["sun"]), (2, 1, [])]
    pages = spark.createDataFrame(words, "doc_id long, page_idx long, words array<string>")
    asked = spark.createDataFrame([("a", 1, None, 1, ["x"]), ("b", 1, "sun", 7, ["x"]), ("c", 2, "sun", 0, ["Sun"]), ("d", 2, "sun", 1, None), ("e", 3, "sun", 0, ["sun"]), ("f", None, "sun", 0, ["sun"])], "question_id string, doc_id long, question string, gold_page long, golds array<string>")
    got = {(r["level"], r["question_id"]): tuple(r)[3:] for r in E.noise_experiment(asked, pages, (0, 2), 1, mode="maxconf", k=2).collect()}
    assert {q for _, q in got} == {"a", "c", "d"} and len(got) == 6
    assert got[0, "a"] == (2, 0.0, 0.0, 0.0) and got[0, "c"] == (2, 1.0, 1.0, 1.0) and got[0, "d"] == (2, 0.0, None, 0.0)


def test_best_chunks_of_blocks(monkeypatch):
    """Chunks that pass by a few at a time leave the best of all, of equal ones the first."""
    rng = np.random.default_rng(2)
    runs, k, n, asks = [(0, 0), (3, 0), (8, 0), (8, 1)], 4, 60, 5
    own = rng.random(n) < 0.4
    rep, drawn = np.where(own, -1, rng.integers(0, 2, n)), np.where(own, 0, rng.integers(0, 8, n))
    vectors, asking = rng.integers(0, 3, (n, 3)).astype(float), rng.integers(1, 3, (asks, 3)).astype(float)
    pages = pa.table({"own": own.astype(int), "rep": rep, "k": drawn, "chunk_id": np.zeros(n, int), "page_idx": np.arange(n)})
    monkeypatch.setattr(E, "CELLS", 20)
    held = E._Held(runs, k)
    held.ask(pa.table({"page_idx": pa.array([0] * asks)}), asking)
    for s in range(0, n, 7):
        held.meet(pages.slice(s, 7), vectors[s : s + 7], [str(i) for i in range(s, min(n, s + 7))])
    near = asking @ vectors.T / (np.sqrt((asking**2).sum(1))[:, None] * np.sqrt((vectors**2).sum(1)) + 1e-8)
    for r, (level, number) in enumerate(runs):
        mine = [i for i in range(n) if own[i] or (rep[i] == number and drawn[i] < level)]
        for q in range(asks):
            want = sorted(mine, key=lambda i: (-near[q, i], i))[:k]  # noqa: B023
            assert [held.texts[c] for c in held.refs[r][q]] == [str(i) for i in want]
    assert len(held.texts) <= len(runs) * asks * k and held.n_pages == own.sum()
