"""Each stage of the pipeline against brute force or a library, on odd rows: nulls, repeats, clashing names, a long text."""

import hashlib
import re
import struct

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from folioscan.llm import bpe, simhash

WORDS = "the cat and the dog are here to see what stands in all of these lines that we read today while it rains on the hill".split()
ENGLISH = " ".join(WORDS * 3)
GERMAN = "der hund und die katze sind heute hier um zu sehen was in all diesen zeilen steht die wir lesen während es regnet " * 3
LONG = " ".join(f"{WORDS[i % len(WORDS)]}{i % 101}" for i in range(400_000))  # about 2.5 MB
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text` string"
ROWS = [
    (3, ENGLISH, "en", "a", 1, "x"), (5, GERMAN, "de", "b", 1, "x"), (5, ENGLISH, "en", "a", 1, "x"), (5, GERMAN, "de", "b", 1, "x"), (5, GERMAN, "de", "b", 1, "x"),
    (7, None, None, None, None, None), (8, "", "en", "a", 0, None), (9, "123 456", "en", None, 7, None), (None, ENGLISH + " once more", "en", None, None, "y"), (None, "mail ann@host.org from the old house by the river that we see today", "en", "a", 3, "z"),
    (21, GERMAN, "de", "b", 1, "x"), (11, "call (212) 555-0147 or write to bob@site.com and the others that are here", "en", "b", 5, None), (12, LONG, "en", "c", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def words(text):
    return re.findall("[^ \t-\r]+", text or "")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, docs, name):
    out = stage(name)(spark, docs.limit(0), "")
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)


def test_language(spark, docs):
    got = stage("language_id")(spark, docs, "")
    assert got.columns == docs.columns
    kept = got.toDF("d", "t", "l", "s", "n", "x").collect()
    assert all(r["t"] and re.search("[a-z]", r["t"]) for r in kept) and {r["l"] for r in kept} <= {"en", "de"}
    letters = [r for r in ROWS if r[1] and re.search("[a-z]", r[1])]
    assert all((r["d"], r["t"], r["s"], r["n"], r["x"]) in [(x[0], x[1], x[3], x[4], x[5]) for x in letters] for r in kept)
    assert sum(r["t"] == ENGLISH for r in kept) == sum(x[1] == ENGLISH for x in letters) and sum(r["t"] == LONG for r in kept) == 1
    assert all(r["l"] == ("de" if r["t"] == GERMAN else "en") for r in kept if r["t"] in (ENGLISH, GERMAN)) and sum(r["t"] == GERMAN for r in kept) == 4


def fingerprint_groups(rows):
    fps = [simhash.fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_near_duplicates_keep_rows(spark, docs):
    """Of each group of rows one stays, and it has the group's least doc_id; rows without one come last."""
    got = in_order(stage("near_duplicates")(spark, docs, "").toDF("d", "t", "l", "s", "n", "x").collect())
    groups = {}
    for label, row in zip(fingerprint_groups(ROWS), ROWS, strict=True):
        groups.setdefault(label, []).append(row)
    assert len(got) == len(groups)
    for rows in groups.values():
        least = min((r[0] for r in rows if r[0] is not None), default=None)
        assert sum(r in rows and r[0] == least for r in got) == 1
    assert sum(r[1] == GERMAN for r in got) == 1 and (3, ENGLISH, "en", "a", 1, "x") in got


def test_personal_data(spark, docs):
    got = stage("personal_data")(spark, docs, "").toDF("d", "t", "l", "s", "n", "x").collect()
    assert len(got) == len(ROWS)
    assert all(r["n"] == (None if r["t"] is None else len(r["t"])) for r in got)
    texts = {r["d"]: r["t"] for r in got}
    assert texts[11] == "call <phone> or write to <email> and the others that are here" and texts[12] == LONG
    assert "mail <email> from the old house by the river that we see today" in {r["t"] for r in got}


def test_mixing(spark, docs):
    """No row's words are taken more than twice, runs of words stand in its text, and columns come along."""
    got = stage("mixing")(spark, docs, "").toDF("d", "t", "l", "s", "n", "x").collect()
    assert all(r["n"] == len(r["t"]) for r in got)
    taken = {}
    for r in got:
        assert any((d, lang, s, x) == (r["d"], r["l"], r["s"], r["x"]) and all(part in t for part in r["t"].split("\n")) for d, t, lang, s, _, x in ROWS if t)
        taken[r["d"], r["l"], r["s"], r["x"]] = taken.get((r["d"], r["l"], r["s"], r["x"]), 0) + len(words(r["t"]))
    for key, n in taken.items():
        assert n <= 2 * sum(len(words(t)) for d, t, lang, s, _, x in ROWS if (d, lang, s, x) == key)


def test_encoded_text_is_the_mixed_text(spark, docs):
    ranks = bpe.load(bpe.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed = stage("mixing")(spark, docs, "").cache()
    want = []
    for r in mixed.toDF("d", "t", "l", "s", "n", "x").collect():
        ids = library.encode_ordinary(r["t"])
        want.append((r["d"], len(ids), bytearray(struct.pack(f"<{len(ids)}I", *ids)), hashlib.sha256(r["t"].encode()).hexdigest()))
    assert in_order(stage("byte_bpe")(spark, mixed, "").collect()) == in_order(want)


def test_run_by_its_stages(spark, tmp_path):
    """run() gives what its stages give one after the other, and leaves one row of every group of near-duplicates."""
    plain = [r[:5] for r in ROWS if r[0] != 12]
    spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert in_order(got.collect()) == in_order(docs.collect()) and got.count() > 0
