"""The noise experiment against plain Python on a small grid."""

import math
import statistics

import numpy as np

from folioscan.operators import models as M
from folioscan.plans import experiment as E

TEXTS = ["red fox sleeps in the den.", "a blue bird sings at dawn.", "rain falls on the hill.", "zebra crossing ahead.", "snow melts in spring.", "the old mill grinds corn.", "ships sail at noon.", "fox and bird and rain."]
PAGES = [(d, p, TEXTS[(d * 3 + p) % 8].split()) for d, n in ((1, 3), (2, 1), (4, 2), (9, 4), (11, 2)) for p in range(n)]
ASKED = [(f"q{d}-{p}", d, " ".join([*w[:2], *TEXTS[(d + p + 3) % 8].split()[:2]]), p, [" ".join(w).upper(), "other"]) for d, p, w in PAGES if (d + p) % 2]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(levels, reps, seed, k):
    docs = sorted({d for d, *_ in PAGES})
    own = {d: [w for x, _, w in PAGES if x == d] for d in docs}
    steps = [x for x in range(1, 200) if math.gcd(x, len(docs) - 1) == 1][:16]
    out = []
    for level in levels:
        for rep in range(reps):
            s = seed + rep
            for name, d, question, gold, golds in ASKED:
                at, n = docs.index(d), len(own[d])
                rows = [(p, 1, 0, w, p) for p, w in enumerate(own[d])]
                for j in range(level):
                    to = (at + 1 + (at * 31 + s * 17 + j * steps[(at + s) % len(steps)]) % (len(docs) - 1)) % len(docs)
                    other = own[docs[to]]
                    rows.append(((at * 3 + j * 5 + s) % (n + 1), 0, j, other[(at * 5 + to * 3 + j * 7 + s) % len(other)], None))
                rows.sort(key=lambda r: r[:3])
                texts = [" ".join(r[3]) for r in rows]
                v = np.asarray(M.HashedTerms().embed([question, *texts]), float)
                sims = [float(v[0] @ x / (np.linalg.norm(v[0]) * np.linalg.norm(x) + 1e-8)) for x in v[1:]]
                best = sorted(range(len(rows)), key=lambda i: (-round(sims[i], 9), i))[:k]
                pred = M.BestSentence().answer([question], [" ".join(texts[i] for i in best)])[0][0].lower()
                score = max(x if (x := 1 - lev(g.lower(), pred) / max(len(g), len(pred))) > 0.5 else 0.0 for g in golds)
                new = next(i for i, r in enumerate(rows) if r[4] == gold)
                out.append((level, rep, name, n, round(score, 6), float(pred in [g.lower() for g in golds]), float(new in best)))
    return out


def test_experiment(spark):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_idx long, words array<string>").repartition(3)
    asked = spark.createDataFrame(ASKED, "question_id string, doc_id long, question string, gold_page long, golds array<string>")
    scores = E.noise_experiment(asked, pages, (0, 2, 6), 2, seed=5, k=3)
    got = sorted((r["level"], r["rep"], r["question_id"], r["n_pages"], round(r["anls"], 6), r["accuracy"], r["precision"]) for r in scores.collect())
    want = sorted(plain((0, 2, 6), 2, 5, 3))
    assert got == want and len({r[4] for r in want}) > 1
    bins = {(r["level"], r["n_pages"]): (r["samples"], round(r["anls"], 6), round(r["anls_std"], 6), round(r["precision"], 6)) for r in E.by_pages(scores).collect()}
    for (level, n), told in bins.items():
        names = sorted({r[2] for r in want if (r[0], r[3]) == (level, n)})
        of = lambda name, i: [r[i] for r in want if r[0] == level and r[2] == name]  # noqa: B023, E731
        mean = lambda f: round(statistics.mean(f(x) for x in names), 6)  # noqa: B023, E731
        assert told[0] == len(names)
        assert np.allclose(told[1:], (mean(lambda x: statistics.mean(of(x, 4))), mean(lambda x: statistics.pstdev(of(x, 4))), mean(lambda x: statistics.mean(of(x, 6)))), atol=2e-6)  # noqa: B023


def test_mined_pairs(spark, tmp_path):
    from folioscan import catalog
    from folioscan.plans import mining as N

    pages = spark.createDataFrame(PAGES, "doc_id long, page_idx long, words array<string>").repartition(3)
    asked = spark.createDataFrame(ASKED, "question_id string, doc_id long, question string, gold_page long, golds array<string>")
    for k, least in ((1, 0.8), (3, 0.8), (3, 0.5)):
        want = set()
        for name, d, question, _, golds in ASKED:
            own = [(p, " ".join(w)) for x, p, w in PAGES if x == d]
            v = np.asarray(M.HashedTerms().embed([question, *(t for _, t in own)]), float)
            sims = [float(v[0] @ x / (np.linalg.norm(v[0]) * np.linalg.norm(x) + 1e-8)) for x in v[1:]]
            for i in sorted(range(len(own)), key=lambda i: (-round(sims[i], 9), i))[:k]:
                pred = M.BestSentence().answer([question], [own[i][1]])[0][0].lower()
                score = max(1 - lev(g.lower(), pred) / max(len(g), len(pred)) for g in golds)
                if score > least:
                    want.add((name, own[i][0], 0, question, own[i][1], round(score, 6)))
        got = {(*tuple(r)[:5], round(r["score"], 6)) for r in N.mined_pairs(asked, pages, k, least).collect()}
        assert got == want and got
    turns = [(1, 0, "user", "Where is the mill? I look for it."), (1, 1, "assistant", "By the river. It grinds corn."), (1, 2, "assistant", None), (2, 0, "user", "Thanks.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = catalog.queries()["mined_pairs"](spark, str(tmp_path)).collect()
    assert {(r["question_id"], r["page_idx"]) for r in rows} == {("1:0", 0), ("2:0", 0)}
