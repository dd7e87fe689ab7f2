"""The queries as they are returned, against libraries and plain loops, on a small table of odd rows; models against enumeration."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscan.llm import binary, bpe, language, media, mixing, pii, quality, registry, sample, simhash, token_count, toxicity

LONG = "Lorem ipsum dolor sit amet. " * 40_000
TEXTS = [None, "", " ", "a", "don't we'll 'r", "ä ö ü Z É", "日本語テキスト" * 30, "a<|endoftext|>b", "1.2.3.4 a@b.co +1 (555) 010-0000 4111111111111111", "the cat sat on the mat " * 30, "same text", "same text", "\x1c\x85 é\n\né", "###\n###\n## &", "x" * 5000, LONG]
SOURCES = [None, "b", "a", "Z", "ä"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: every odd text with several ids and sources, repeated rows, a null id, and a tiny source."""
    folder = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, "en" if i % 2 else "de", SOURCES[i % 5], None) for i, t in enumerate(TEXTS * 3)]
    rows += [(4, TEXTS[4], "en", "Z", None), (4, TEXTS[4], "en", "Z", None), (4, "another text of one id", "en", "Z", None), (None, "no id", None, None, None), (900, "ten small words of a source that is tiny, no more", "en", "tiny", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def run(spark, name, folder):
    return registry.queries()[name](spark, folder).collect()


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def in_order(rows):
    return sorted(rows, key=str)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op1(spark, small):
    folder, rows = small
    ranks = bpe.load(bpe.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := library.encode_ordinary(r[1] or "")), sha(packed(ids)), sha((r[1] or "").encode())) for r in rows]
    assert in_order(tuple(r) for r in run(spark, "op1_byte_bpe", folder)) == in_order(want)


def test_op1_memo_is_bounded():
    coder = bpe.RankBPE(bpe.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN)
    coder.encode(["日本語" * 1000, "word " * 10])
    assert all(len(c) <= bpe.KEPT for c in coder.memo) and coder.memo


def test_op2(spark, small):
    folder, rows = small
    want = []
    for doc_id, text, *_ in rows:
        data = media.payload(text)
        stored = media.wav(data)
        want.append((doc_id, len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    got = run(spark, "op2_audio_features", folder)
    assert in_order(tuple(r)[:7] for r in got) == in_order(want)
    assert len({r["feature"] for r in got if r["payload_sha256"] == got[0]["payload_sha256"]}) == 1
    for r in got:
        samples = media.payload(next(t for d, t, *_ in rows if d == r["doc_id"] and hashlib.sha256(media.payload(t)).hexdigest() == r["payload_sha256"]))
        tensors, loud = media.features(samples)
        assert [(x["start_s"], x["end_s"]) for x in r["loud"]] == loud and r["n_tensors"] == media.read_tensors(tensors).num_rows


def test_op2_table(spark, small, tmp_path):
    folder, rows = small
    media.write(spark.read.parquet(f"{folder}/documents.parquet"), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).collect()
    assert in_order((r["doc_id"], media.read_wav(bytes(r["media"]))[0]) for r in back) == in_order((r[0], media.payload(r[1])) for r in rows)


def plain_log_mel(data):
    """Every step as its definition: the filter's sums, the transform's sums, the triangles' sums."""
    x = [(b - 128) / 128 for b in data]
    at = lambda i: x[i] if 0 <= i < len(x) else 0.0
    y = []
    for k in range(len(x) * media.UP // media.DOWN):
        group, phase = divmod(k, media.UP)
        y.append(sum(at(group * media.DOWN - (media.TAPS // 2 - 1) + j) * float(media._FILTERS[j, phase]) for j in range(media.TAPS)))
    n = 1 + max(0, -(-(len(y) - media.FRAME) // media.HOP))
    y += [0.0] * (n * media.HOP + media.FRAME)
    out = []
    for k in range(n):
        frame = [y[k * media.HOP + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / media.FRAME)) for i in range(media.FRAME)]
        power = [abs(sum(v * complex(math.cos(a := -2 * math.pi * f * i / media.FRAME), math.sin(a)) for i, v in enumerate(frame))) ** 2 for f in range(media.FRAME // 2 + 1)]
        out.append([10 * math.log10(sum(p * float(media._MEL[f, b]) for f, p in enumerate(power)) + 1e-6) for b in range(media.MELS)])
    return np.array(out)


def test_log_mel_by_its_definition(monkeypatch):
    data = media.payload("How loud is a text? " * 40)
    want = plain_log_mel(data)
    x = np.frombuffer(data, np.uint8)
    assert np.abs(media.log_mel(x) - want).max() < 0.05
    whole = media.resample(x)
    assert np.allclose(np.concatenate([media.resample(x, a, min(a + 100, len(whole))) for a in range(0, len(whole), 100)]), whole, atol=1e-6)
    monkeypatch.setattr(media, "STEP", 2)
    assert np.abs(media.log_mel(x) - want).max() < 0.05
    table = media.read_tensors(media.tensors(media.log_mel(x)))
    held = np.concatenate(table.column("log_mel").combine_chunks().to_numpy_ndarray())
    assert np.abs(held[: len(want)] - want).max() < 0.05 and (held[len(want) :] == -60).all()
    second = media.HOP * media.DOWN / (media.RATE * media.UP)
    assert table.column("start_s").to_pylist()[0] == 0 and abs(table.column("end_s").to_pylist()[-1] - len(want) * second) < 1e-5


def test_op3(spark, small):
    folder, rows = small
    size = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), [s for s in order if sizes[s]], 1.5 * sum(sizes.values())
    while open_:  # the excess of one full source after the other is shared anew
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    got = run(spark, "op3_mixing", folder)
    want = in_order((r[0], size(r[1]), sizes[r[3]], round(target[r[3]], 6)) for r in rows)
    assert in_order((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in order:
        own = [r for r in got if r["source_size"] == sizes[s] and round(r["target"], 6) == round(target[s], 6)]
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 2 * max(1, min(mixing.BLOCK, sizes[s] // mixing.FINE))
    assert in_order(map(tuple, got)) == in_order(map(tuple, run(spark, "op3_mixing", folder)))


def test_mixed_rows_of_one_id(spark, small):
    """Rows that share a doc_id are mixed each for itself: the words of every text are taken as often as the counts say."""
    folder, rows = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    mix = {}
    for r in mixing.mixed_texts(docs).collect():
        mix[r["doc_id"]] = mix.get(r["doc_id"], 0) + words(r["text"])
        assert any(d == r["doc_id"] and all(part in t for part in r["text"].split("\n") if "\n" not in t) for d, t, *_ in rows if t)
    taken = {}
    for r in mixing.Mix(docs).taken().collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert mix == {d: n for d, n in taken.items() if n}


def test_op3_by_plain_loops(spark):
    """Blocks, draws, permutations and the join, done by loops from the slots alone."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 2}") for i in range(60)], "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block=4, slots=8)
    held = sorted((r["k"], r["at"], r["doc_id"], r["size"], r["width"]) for r in mix.placed().collect())
    place = {}
    for k, at, doc_id, n, width in held:
        for i in range(n):
            place.setdefault((k, (at + i) // width), []).append(doc_id)
    taken = dict.fromkeys(range(60), 0)
    slots = mix.slots().collect()
    for r in slots:
        for d in place[r["k"], r["index"]]:
            taken[d] += 1
    for k in {r["k"] for r in slots}:  # a pass takes no block twice, and is whole before the next one begins
        for p in {r["pass"] for r in slots if r["k"] == k}:
            own = [r["index"] for r in slots if r["k"] == k and r["pass"] == p]
            assert len(own) == len(set(own))
    assert {r["doc_id"]: r["taken"] for r in mix.taken().collect()} == taken


def test_op5_viterbi_and_training():
    field = pii.field()
    rng = random.Random(4)
    pool = ["call", "+1", "(212)", "555-0147", "10.1.2.3", "ann", "(at)", "host", "(dot)", "org", "4111111111111111", "12", "of"]
    for _ in range(12):
        words = [rng.choice(pool) for _ in range(4)]
        score, _ = field.potentials([words])
        paths = {p: field.move[-1, p[0]] + sum(score[0, t, k] for t, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(len(pii.TAGS)), repeat=4)}
        assert abs(paths[tuple(field.decode([words])[0])] - max(paths.values())) < 1e-9
    rows = pii.labelled()
    tagged = field.decode([w for w, _ in rows])
    assert all([pii.TAGS[k] for k in got] == tags for got, (_, tags) in zip(tagged, rows, strict=True))


def test_op5_gains_likelihood():
    """Training raises the labelled rows' likelihood, which is counted here by enumerating all paths."""
    rows = [(["a", "10.1.2.3"], ["O", "B-ip"]), (["x", "(at)"], ["B-email", "I-email"]), (["in", "1999"], ["O", "O"])]

    def likelihood(field):
        total = 0.0
        for words, tags in rows:
            score, _ = field.potentials([words])
            each = {p: field.move[-1, p[0]] + sum(score[0, t, k] for t, k in enumerate(p)) + field.move[p[0], p[1]] for p in itertools.product(range(len(pii.TAGS)), repeat=2)}
            total += each[tuple(pii.TAGS.index(t) for t in tags)] - np.logaddexp.reduce(list(each.values()))
        return total

    found = [likelihood(pii.train(rows, steps)) for steps in (1, 5, 40)]
    assert found[0] < found[1] < found[2] < 0 and found[2] > -0.3


def test_op5_long_words_and_decoys():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b, _ in pii.spans([t])[0]]
    name = "x" * 60
    assert found(f"mail {name}(at)host.com now") == [("email", f"{name}(at)host.com")]
    assert found("," * 200 + "call (212) 555-0147 now") == [("phone", "(212) 555-0147")]
    made = pii.Maker(77)
    for _ in range(20):
        assert found(f"sum {made.digits(12)} of {made.card_like().replace(' ', '')} in 2024-05-06") == []
    assert found("call +1 (843) 555-7672 170.106.47.218 now")[:1] == [("phone", "+1 (843) 555-7672")]


def test_op6_by_plain_cosines(spark):
    docs = [(i, ("the cat and the dog are here " if i % 2 else "der hund und die katze sind da ") * (1 + i % 4), "en" if i % 2 else "de") for i in range(40)]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = ["the dog", "katze und hund", "xyzzy", "the katze"]
    for text, name, score, rejected in zip(texts, *model.predict(texts), strict=True):
        low = b"  " + text.lower().encode() + b"  "
        data = [32 if b < 97 or 123 <= b < 128 else b for b in low]
        counts = np.zeros(language.DIMENSIONS)
        for i in range(len(data) - 1):
            two = (data[i] * 257 + data[i + 1]) % 2**32
            counts[(two * 2654435761 % 2**32) >> 20] += 1
            if i + 2 < len(data):
                counts[((two * 257 + data[i + 2]) * 2654435761 % 2**32) >> 20] += 1
        v = np.log1p(counts) * model.idf
        close = model.centres @ v / np.linalg.norm(v)
        best = int(close.argmax())
        assert (name, rejected) == (model.names[best], bool(close[best] < model.floor[best] * math.sqrt(min(1, counts.sum() / language.FULL))))
        assert abs(score - max(0, close[best])) < 1e-4
    assert model.predict(["the dog"] * 3)[1] == [model.predict(["the dog"])[1][0]] * 3


def test_op6_query(spark, small):
    folder, rows = small
    got = run(spark, "op6_language_id", folder)
    assert in_order((r["doc_id"], r["held_out"]) for r in got) == in_order((r[0], remainder(r[0], 4) == 2) for r in rows)
    text = {r[0]: r[1] for r in rows if r[0] not in (4, None)}
    assert all((r["lang_pred"] == "und") == (not language.LETTER.search(text[r["doc_id"]] or "")) for r in got if r["doc_id"] in text)


def test_samples(spark):
    """No long or repeated row and no label keeps the others out."""
    rows = [(i, "de", 30_000_000) for i in range(100)] + [(1000 + i, "en", 10) for i in range(100)] + [(5000, "fr", 10)] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, lang string, n long")
    got = {}
    for r in sample.choose(docs, "lang", 50).collect():
        got.setdefault(r["lang"], []).append(r["doc_id"])
    assert sorted(got) == ["en", "fr"] and len(set(got["en"])) == 50 and got["fr"] == [5000]
    assert sample.choose(docs.filter("lang = 'de'"), "lang", 50).count() == 1
    many = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 1500 AS STRING) AS lang", "1L AS n")
    assert 1000 <= sample.choose(many, "lang", 50, most=1000).count() <= 1000


def test_op7(spark, small):
    folder, rows = small
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows]
    assert in_order(tuple(r) for r in run(spark, "op7_token_counts", folder)) == in_order(want)


@pytest.mark.parametrize("around", ["a{}1", " {}!"])
def test_every_code_point(around):
    path = P.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_count.load(path)
    for k in range(1, 0x110000, 40_000):
        texts = [around.format(chr(c)) for c in range(k, min(0x110000, k + 40_000)) if not 0xD800 <= c < 0xE000]
        assert counter.count(texts)[1].tolist() == [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_op8(spark, small):
    folder, rows = small
    got = run(spark, "op8_toxicity", folder)
    assert in_order((r["doc_id"], r["held_out"]) for r in got) == in_order((r[0], remainder(r[0], 5) == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_noisy_or_by_its_product(spark):
    words = [f"w{i}" for i in range(30)]
    rng = random.Random(9)
    text = lambda bad: ". ".join(" ".join(rng.choice(words) for _ in range(5)) + (" vile" if bad and k == 1 else "") for k in range(3))
    made = [(i // 2, text(i // 2 % 3 == 0)) for i in range(240)]  # every doc_id has two rows
    docs, labels = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] * 2, "doc_id long, toxic int")
    chosen = toxicity.choose(docs.selectExpr("doc_id", "1L AS n").join(labels, "doc_id"), "toxic", 2000)
    assert chosen.count() == 120 and toxicity.texts_of(docs, chosen, "toxic").count() == 120
    model = toxicity.fit(docs, labels)
    texts = [t for _, t in made[:20]] + ["", "no known word", "vile. vile! vile?"]
    for t, score in zip(texts, model.score(texts).tolist(), strict=True):
        quiet = 1 - 1 / (1 + math.exp(-model.bias))  # a document also has a sentence without any word
        for s in re.findall(r"[^.!?\n]*[.!?\n]?", t):
            z = [float(w) for w in model.weigh(toxicity.instances([s])[0])] if s else []
            if any(z):
                quiet *= 1 - 1 / (1 + math.exp(-(model.bias + sum(z))))
        assert abs(score - (1 - quiet)) < 2e-6


def plain_em(patterns, steps=100):
    """Row by row, without weights or arrays."""
    rows = [p for p, n in sorted(patterns.items()) for _ in range(n)]
    rules = range(len(rows[0]))
    rate, good = {(v, k, i): quality.START[v, k] for v in "-0+" for k in (0, 1) for i in rules}, quality.GOOD
    for _ in range(steps):
        chance = []
        for p in rows:
            one, zero = good, 1 - good
            for i, v in enumerate(p):
                one, zero = one * rate[v, 1, i], zero * rate[v, 0, i]
            chance.append(one / (one + zero))
        for k in (0, 1):
            share = [c if k else 1 - c for c in chance]
            for v, i in itertools.product("-0+", rules):
                rate[v, k, i] = (sum(s for s, p in zip(share, rows, strict=True) if p[i] == v) + quality.PRIOR * quality.START[v, k]) / (sum(share) + quality.PRIOR)
        good = (sum(chance) + quality.PRIOR * quality.GOOD) / (len(rows) + quality.PRIOR)
    return dict(zip(rows, chance, strict=True))


def test_op9(spark, small):
    patterns = {"+++": 60, "-+0": 9, "--+": 12, "0+-": 4}
    got, want = quality.fit(patterns)[0], plain_em(patterns)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    folder, rows = small
    found = run(spark, "op9_quality_rules", folder)
    counted = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall("[^ \t-\r]+", t)
        seen, repeated = {}, set()
        for i in range(len(words) - 4):
            seen.setdefault(tuple(words[i : i + 5]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                repeated.update(j for i in at for j in range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
        n = len(words)
        counted.append((doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n))
    assert in_order(tuple(r)[:7] for r in found) == in_order(counted)
    assert all(r["kept"] == (not r["base_failed"] and r["chance"] >= 0.5) for r in found)


def test_op10(spark, small):
    folder, rows = small
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for t in {r[1] for r in rows}}
    got = run(spark, "op10_token_files", folder)
    assert in_order((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == in_order((r[0], len(ids[r[1]]), zlib.crc32(packed(ids[r[1]]))) for r in rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [sum(r["n_tokens"] for r in order[:i]) for i in range(len(order))]
    known = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert known == sorted(known) and order[0]["doc_id"] is None


def test_op10_hot_ids_and_one_document(spark, tmp_path):
    """A doc_id with a third of all rows is spread over ranges in order; one document is read from its own shard."""
    rows = [(77 if i % 3 == 0 else None if i % 11 == 1 else i, "the same text" if i % 6 == 0 else f"text number {i % 500}") for i in range(3000)]
    path = str(tmp_path / "hot")
    binary.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, shard_bytes=4000, ranges=12)
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.filter("array_contains(doc_ids, 77L)").select("range").distinct().count() >= 4
    got = sorted(binary.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == 3000 and [r["doc_id"] or -1 for r in got] == sorted(r[0] or -1 for r in rows)
    assert binary.shards_of(spark, path, [2999]).count() < shards.count() / 4
    few = binary.read_ids(spark, path, [2999, 4])
    assert in_order((r["doc_id"], r["start"]) for r in few.collect()) == in_order((r["doc_id"], r["start"]) for r in got if r["doc_id"] in (4, 2999))


def test_op10_coder_agrees_with_the_library():
    library, coder = Tokenizer.from_file(P.path("word_bpe_49k.json")), binary.load(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t'sSalRevmd1é日!\x1f É×÷²½ß\xad\x85\xa0<|") for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x180), rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    texts += ["a" * 5000, "é" * 3000, "don't <|endoftext|> x", "'s 't", ""]
    for t, e, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t


def test_word_memo_starts_afresh():
    """A memo of a few words gives the same ids as one that holds all, and never holds more than it may."""
    from folioscan.llm.wordmemo import WordMemo, texts_as_bytes, words

    asked = lambda ws: (np.array([w[0] for w in ws], "<u4"), np.ones(len(ws), np.int64))
    memo = WordMemo(asked, most=16)
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 40) for _ in range(30))
        data, _ = texts_as_bytes([text])
        ids, n = memo.encode(data, *words(data))
        assert ids.tolist() == [ord(w[0]) for w in text.split()] and n.tolist() == [1] * 30 and memo.words <= 16


@pytest.mark.parametrize("split", [3, 25])
def test_op4_splits_again(spark, monkeypatch, split):
    """Fingerprints that share most of their bits, so that a quarter is split by level after level."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(split)
    fps = sorted({(rng.getrandbits(7) << 57) | rng.getrandbits(9) for _ in range(160)})
    table = spark.createDataFrame([((x ^ 1 << 63) - (1 << 63),) for x in fps], "fp long")
    label = {x: x for x in fps}
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near(table).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    for _ in fps:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: x for x in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if a < b and (a ^ b).bit_count() <= 3:
                    want[a] = want[b] = min(want[a], want[b])
        if all(want[a] == want[b] for a in fps for b in fps if (a ^ b).bit_count() <= 3):
            break
    assert label == want
