"""Spelling variants against plain loops over all words, in the tries as dealt and with every limit lowered."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioscan.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def plain(rows):
    n = words_of(rows)
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w in n:
        found = [x for m in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(m, ()) if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], n_near[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus(seed, stems, letters):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(stems)]
    words += ["banana" * 3, "aaaaa", "aaaaaa", "aaaaaaa", "straße", "stra×e", "strasse", "äöüÄÖ", "x" * 700 + "y" * 700, "x" * 701 + "y" * 699]
    forms = []
    for w in words:
        for _ in range(rng.randrange(1, 6)):
            i, kind = rng.randrange(len(w) + 1), rng.randrange(4)
            v = w if not kind else w[:i] + rng.choice(letters) + w[i:] if kind == 1 else w[:i] + w[i + 1 :] if kind == 2 else w[:i] + rng.choice(letters) + w[i + 1 :]
            forms += [v] * rng.choice([1, 3, 4, 8, 20])
    rng.shuffle(forms)
    rows = [(i if i % 9 else None, " ".join(forms[i::40]) + (" Schluss-Wort, END." if i % 2 else " 中"), "x") for i in range(40)]
    return [*rows, *rows[:3], (77, None, "x"), (78, "", "y"), (79, "a bc d1e2f " + "Hello World " * 100_000, "z")]


@pytest.mark.parametrize(("seed", "letters", "split", "chunk_bytes"), [(1, "abcdefgh", 50_000, 16 << 20), (3, "abcé", 1, 400), (4, "abc", 6, 16 << 20)])
def test_spelling(spark, tmp_path, monkeypatch, seed, letters, split, chunk_bytes):
    for name, value in (("SPLIT", split), ("CHUNK_BYTES", chunk_bytes), ("COUNTED", 500)):
        monkeypatch.setattr(spelling, name, value)
    rows = corpus(seed, 250, letters)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        spark.createDataFrame(rows, "doc_id long, text string, `TEXT` string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        got = sorted(map(tuple, spelling.op11_spelling(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    want = plain(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != (r[1] or r[0]) for r in want)


@pytest.mark.parametrize(("chunk", "pairs"), [(100_000, 200_000), (3, 1)])
def test_tries_in_chunks(monkeypatch, chunk, pairs):
    """The join of one task, with each of its steps cut small."""
    import numpy as np

    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "CHUNK_BYTES", 1 << 20 if pairs > 1 else 8)
    rng = random.Random(chunk)
    groups = [sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(60)}) for _ in range(4)]
    words = [w for g in groups for w in g]
    number = np.repeat(np.arange(4), [len(g) for g in groups])
    limit = np.array([1 << 40, 2, 1, 1 << 40])[number]
    tries = spelling.Tries([w.encode("latin-1") for w in words], number, limit)
    got = [(int(x), int(y)) for a, b in tries.near() for x, y in zip(a, b, strict=True)]
    assert len(got) == len(set(got))
    want = set()
    for x in range(len(words)):
        for y in range(len(words)):
            if number[x] == number[y] and near(words[x], words[y]) and (len(words[x]), x) < (len(words[y]), y):
                shared = next((k for k in range(len(words[x])) if words[x][k] != words[y][k]), len(words[x]))
                if shared < limit[x]:
                    want.add((x, y))
    assert {(x, y) if (len(words[x]), x) < (len(words[y]), y) else (y, x) for x, y in got} == want


def test_no_words(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert spelling.op11_spelling(spark, str(tmp_path)).collect() == []
