"""The Merkle manifest against lists of digests, level by level."""

import hashlib
import random
import zlib

import pytest

from folioscan.llm import merkle

LOWER = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    told = (None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text))
    return h(*("-" if x is None else f"{len(x.encode())}:{x}" for x in told))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def path(found, i):
    for nodes in found[:-1]:
        first = i // 16 * 16
        yield nodes[first:i], nodes[i + 1 : first + 16]
        i //= 16


def plain(rows):
    """The query's rows and the number of nodes above leaves."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5]))) for s in sources}
    trees = {s: levels([leaf(*r[:5]) for r in of[s]]) for s in sources}
    over = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, text, *rest) in enumerate(r[:5] for r in of[s]):
            steps = [*path(trees[s], i), *path(over, k)]
            bad = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            folded = leaf(doc_id, text.translate(LOWER) if bad else text, *rest)
            for before, after in steps:
                folded = h(*before, folded, *after)
            out.append((doc_id, trees[s][0][i], trees[s][-1][0], over[-1][0], h(*(x for b, a in steps for x in b + a)), folded, folded == over[-1][0]))
    return out, sum(len(x) for t in (*trees.values(), over) for x in t[1:])


def table(n, sources, seed=1):
    rng = random.Random(seed)
    texts = ["Abc", "x y Z", None, "", "ÄÖ A", "plain", "Lorem Ipsum " * 200_000]
    return [(rng.choice([i, i, i, i, 7, None]), rng.choice(texts[: 6 + (i == 5)]), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3]), "x") for i in range(n)]


@pytest.mark.parametrize(
    ("rows", "least", "most"),
    [
        ([], 1000, 1000),
        ([(1, "A", "en", None, 1, "x")], 1000, 1000),
        (table(16, ["a"]), 1000, 1000),
        (table(17, ["a", None]), 1000, 1000),
        (table(1500, ["a"] * 8 + [None, "b", "ä", "Z", ""]), 10, 60),  # partitions that begin and end within runs
        (table(400, [f"s{i}" for i in range(300)]), 10, 60),  # a tree of three levels over the sources
        ([(1, "Same", "en", "a", 1, "x")] * 300, 10, 60),
    ],
)
def test_merkle(spark, tmp_path, monkeypatch, rows, least, most):
    monkeypatch.setattr(merkle, "LEAST_RUN", least)
    monkeypatch.setattr(merkle, "MOST_RUN", most)
    schema = "doc_id long, text string, lang string, source string, n_chars long, `Text` string"
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset("spark.sql.caseSensitive")
    docs = spark.createDataFrame(rows, schema).repartition(3)
    made = merkle.manifest(docs)
    want, nodes = plain(rows) if rows else ([], 0)
    got = made.proofs()
    assert got.count() == len(want)
    assert made.records().distinct().count() == made.records().count() == nodes
    if rows:
        assert made.root == want[0][3]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        result = merkle.op13_merkle(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert sorted(map(tuple, result), key=str) == sorted(want, key=str)
    if len(rows) > 100 and rows[0][1] != "Same":
        assert {r["verified"] for r in result} == {True, False}
