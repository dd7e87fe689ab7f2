"""The corpus operators against libraries and brute force, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from folioscan.llm import binary, bpe, language, media, mixing, pii, quality, registry, simhash, token_count, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text` string, n_tokens string, fp string"
ODD = [None, "", " ", "\n\n", "a", "don't we'll 'r", "x" * 3000, "ä ö ü z", "日本語テキスト" * 50, "a<|endoftext|>b", "1.2.3.4 a@b.co +1 (555) 010-0000 4111111111111111", "the cat sat on the mat " * 400, "same text", "same text", "\x1c\x1d\x85 é"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 0, "clash", "clash", "clash") for i, t in enumerate(ODD)]
    rows += [(3, ODD[5], "de", "s1", 0, None, None, None), (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def test_bpe(odd, none):
    ranks = bpe.load(bpe.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df, rows = odd
    ids = lambda t: library.encode_ordinary(t or "")
    got = bpe.decode_documents(bpe.encode_documents(df)).collect()
    want = [(r[0], len(x := ids(r[1])), struct.pack(f"<{len(x)}I", *x), (r[1] or "").encode()) for r in rows]
    assert by_row(got, "doc_id", "n_tokens", "ids", "decoded") == sorted(((a, b, bytearray(c), bytearray(d)) for a, b, c, d in want), key=str)
    assert bpe.encode_documents(none).count() == 0


def test_bpe_random():
    coder = bpe.load(bpe.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t'salrevmd1é日!\x1f ") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(200)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_token_counts(odd, none):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df, rows = odd
    n = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    got = by_row(token_count.count_tokens(df).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True)), key=str)
    assert token_count.count_tokens(none).count() == 0
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \n'srlveabc1!") for _ in range(rng.randrange(40))) for _ in range(2000)]
    counted = token_count.load(P.path("byte_bpe_50k.json")).count(texts)[1].tolist()
    assert counted == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_media(odd, none):
    df, rows = odd
    got = media.audio_features(media.store(df)).collect()
    for r in got:
        data, rate = media.read_wav(bytes(r["media"]))
        assert rate == media.RATE and data == bytes(r["samples"])
        table = media.read_tensors(bytes(r["tensors"]))
        assert table.schema.field("log_mel").type.shape == [media.BLOCK, media.MELS] and table.num_rows >= 1
    assert by_row(got, "doc_id", "samples") == sorted(((r[0], bytearray(media.payload(r[1]))) for r in rows), key=str)
    assert media.audio_features(media.store(none)).count() == 0
    x = np.sin(np.arange(4000) * 2 * np.pi * 440 / media.RATE).astype(np.float32)
    y, want = media.resample(x), np.sin(np.arange(3000) * 2 * np.pi * 440 / 6000)
    assert len(y) == 3000 and np.abs(y[50:-50] - want[50:-50]).max() < 0.02
    assert media.stretches(np.array([0, 0, 5, 2, 0.5, 0, 0, 9, 9, 0, 0, 0, 0.0])) == [(2, 4), (7, 9)]


def test_mixing(spark, odd, none):
    assert mixing.targets([100, 100, 100]) == [200.0, 83.33333333333333, 166.66666666666666]
    k = np.arange(1000)
    assert sorted(mixing.permuted(k, np.full(1000, 1000), np.full(1000, 7, np.uint64)).tolist()) == k.tolist()
    df, rows = odd
    mix = mixing.Mix(df, block=8, slots=16)
    got = mix.taken().collect()
    size = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    assert by_row(got, "doc_id", "size") == sorted(((r[0], size(r[1])) for r in rows), key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed_texts(df, block=8, slots=16).columns == df.columns and mixing.mixed_texts(df).count() > 0
    assert mixing.mixed_texts(none).count() == 0
    assert by_row(got, "doc_id", "taken") == by_row(mixing.Mix(df, block=8, slots=16).taken().collect(), "doc_id", "taken")
    assert mixing.Mix(none).taken().count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = mixing.Mix(docs).taken().join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in {r["source"] for r in pieces}:
        own = [r for r in pieces if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * mixing.BLOCK
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    words = {r["doc_id"]: 0 for r in pieces}
    for r in texts.collect():
        words[r["doc_id"]] += size(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in pieces}


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^ \t-\r]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {c: min((d for d, x in zip(ids, label, strict=True) if x == c and d is not None), default=None) for c in set(label)}
    return [least[c] for c in label]


def test_simhash(spark, odd, none):
    df, rows = odd
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, plain_components([r[0] for r in rows], fps), strict=True), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = sorted(zip([r["doc_id"] for r in docs], [f"{x:016x}" for x in fps], plain_components([r["doc_id"] for r in docs], fps), strict=True))
    assert sorted(tuple(r) for r in registry.queries()["op4_simhash"](spark, SF).collect()) == want


@pytest.mark.parametrize("split", [1 << 30, 40])
def test_trie_join(spark, monkeypatch, split):
    """All links of dense and sparse fingerprints, with quarters whole and split."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(8)
    near = [sum(1 << b for b in rng.sample(range(30), rng.randrange(5))) for _ in range(150)]
    fps = sorted({*near, *(rng.getrandbits(64) for _ in range(50)), *(x ^ 1 << rng.randrange(64) for x in near[:40])})
    table = spark.createDataFrame([((x ^ 1 << 63) - (1 << 63),) for x in fps], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near(table).collect()]
    assert all(a in fps and b in fps for a, b in links)
    label = {x: x for x in fps}
    for _ in fps:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert [label[x] for x in fps] == plain_components(fps, fps)


PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = (lambda: True, lambda: all(int(x) <= 255 for x in m[0].split(".")), lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), lambda: 10 <= len(digits) <= 15)  # noqa: B023
            if checks[k]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(odd, none):
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("0123 .-@a+()1.2") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    df, rows = odd
    got = sorted(((r["doc_id"], [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["base"]]) for r in pii.find(df).collect()), key=str)
    assert got == sorted(((r[0], plain_spans(r[1] or "")) for r in rows), key=str)
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    assert pii.mask("write bob (at) site (dot) com or call (212) 555-0147.") == "write <email> or call <phone>."
    assert pii.mask("on 2024-05-06 page 12 of 340") == "on 2024-05-06 page 12 of 340"
    assert [r["text"] for r in pii.redact(df).filter("doc_id = 10").collect()] == ["<ip> <email> <phone> <card>"]
    assert pii.spans(["9" * 100_000, "a" * 100_000, "@" * 20_000]) == [[], [], []]


def test_language(spark, odd, none):
    df, rows = odd
    for train in (df, none):
        got = language.identify(df, language.fit(train)).collect()
        assert len(got) == len(rows)
        assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (0, 1, 2))
        assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(none, language.fit(none)).count() == 0
    out = registry.queries()["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out) > 0


def test_toxicity(spark, odd, none):
    df, rows = odd
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (3, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, marks in ((df, labels), (none, labels), (df, labels.limit(0))):
        model = toxicity.fit(docs, marks)
        assert toxicity.score(df, model).count() == len(rows) and toxicity.score(none, model).count() == 0
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    text = lambda bad: " ".join(rng.choice(words) for _ in range(20)) + (". you vile thing. " if bad else ". ") + " ".join(rng.choice(words) for _ in range(20))
    made = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in made], "doc_id long, toxic int"))
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in toxicity.score(docs, model).collect())
    found = {(r["doc_id"], made[r["doc_id"]][1][r["start"] : r["end"]]) for r in toxicity.locate(docs, model).collect()}
    assert len(found) == 100 and all("vile" in t for _, t in found)


def plain_counts(text):
    words = re.findall("[^ \t-\r]+", text)
    seen, repeated = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated.update(j for i in at for j in range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark, odd, none):
    df, rows = odd
    got = by_row(quality.judge(df).collect(), "doc_id", *quality.COUNTS[:5])
    assert got == sorted(((r[0], *plain_counts(r[1] or "")) for r in rows), key=str)
    assert quality.judge(none).count() == 0
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c" * 30, "d\n", "#", "é"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    counts = quality.text_counts(texts)
    assert list(zip(*(counts[c].tolist() for c in quality.COUNTS[:5]), strict=True)) == [plain_counts(t) for t in texts]
    chances, _, _ = quality.fit({"++++++++": 900, "-+++++++": 60, "--++++++": 40})
    assert chances["++++++++"] > 0.9 and chances["--++++++"] < 0.5


def test_token_files(spark, odd, none, tmp_path):
    df, rows = odd
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    binary.write_ids(df, str(tmp_path / "a"), shard_bytes=200)
    got = binary.read_ids(spark, str(tmp_path / "a")).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted(((r[0], bytearray(struct.pack(f"<{len(x := ids(r[1]))}I", *x))) for r in rows), key=str)
    assert by_row(got, "doc_id", "ids") == want
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order if r["doc_id"] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in order:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    few = binary.read_ids(spark, str(tmp_path / "a"), [4, 10]).collect()
    assert sorted((r["doc_id"], r["start"]) for r in few) == sorted((r["doc_id"], r["start"]) for r in got if r["doc_id"] in (4, 10))
    binary.write_ids(none, str(tmp_path / "b"))
    assert binary.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_contract_digests(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.queries()["op2_audio_features"](spark, SF).collect():
        data = media.payload(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(docs[r["doc_id"]].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    for r in registry.queries()["op5_pii"](spark, SF).collect():
        spans = plain_spans(docs[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        if name != "byte_bpe":
            assert after.columns == docs.columns
        if name == "near_duplicates":
            assert after.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
        if name == "personal_data":
            assert not any(plain_spans(r["text"] or "") for r in after.collect())
        docs = after
    assert docs.count() == len(got)
