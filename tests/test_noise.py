"""Draws of other documents' pages."""

from collections import Counter

from folioscan.operators import sampling as S


def test_draws(spark):
    for n, k in ((1, 3), (2, 3), (5, 4), (5, 11), (97, 20)):
        docs = [(100 + 3 * i, i, 1 + i % 4) for i in range(n)]
        frame = spark.createDataFrame(docs, "doc_id long, at long, n_pages long")
        pages = {d: p for d, _, p in docs}
        for seed in (0, 7):
            got = S.noise_draws(frame, n, k, seed).collect()
            assert len(got) == (n * k if n > 1 else 0)
            for d in pages if n > 1 else ():
                others = [r["other"] for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["k"])]
                assert d not in others and max(Counter(others).values()) - min(Counter(others).values()) <= 1
                assert len(set(others)) == min(k, n - 1)
            assert all(0 <= r["page_idx"] < pages[r["other"]] for r in got)
            assert n < 5 or {r["other"] for r in got} == set(pages)
        if n > 5:
            a, b = (sorted(map(tuple, S.noise_draws(frame, n, k, s).collect())) for s in (0, 7))
            assert a != b and a == sorted(map(tuple, S.noise_draws(frame.repartition(3), n, k, 0).collect()))
