"""Token ids in binary files: each document a zstandard frame with a shared dictionary, found by an offset index.

A file set is a folder with three Parquet tables (so any store that Spark writes can hold it):
- `dictionary`: one row; the zstandard dictionary and its SHA-256. It is trained on the serialised ids of SAMPLE documents.
- `shards`: a row for each shard of at most SHARD_BYTES of frames: the frames one after the other in `frames`, and the
  index over them: the least and largest doc_id, and for each document its id, the byte at which its frame ends, its number
  of ids, and the ids before it in this range. `dictionary_sha256` says which dictionary opens them. One document is found by
  the statistics of `first_doc` and `last_doc`, and costs its shard.
- `ranges`: the ids in each range of doc_ids; with them a document's start in the whole corpus follows.
Documents are in ascending doc_id order; rows of equal doc_id are ordered by their text's XXH64 (equal texts may change
places); null doc_ids come first. A null or empty text is a document of the end id alone. A very long text is a frame of its
own, whose shard may exceed SHARD_BYTES; an empty table gives no shards. Columns other than doc_id and text don't matter.
A doc_id with a large share of all rows is spread over several ranges.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import documents, pick, shared_dir, slices
from .wordmemo import WordMemo, join, ragged, words

SHARD_BYTES = 1 << 20
END_ID = 1
#: The dictionary is fitted on this many documents, those of least hash.
SAMPLE = 1000
DICTIONARY_BYTES = 64 << 10
LEVEL = 1


# Classes of bytes, in lower case; a two-byte character of Latin-1 has its class on both bytes.
_ODD, _BLANK, _LETTER, _NUMBER, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _NUMBER
_CLASS[[*range(0x1C, 0x20), *range(0x80, 0x100)]] = _ODD
#: The same of U+0080 to U+00FF: white space is odd, ª µ º are letters, ² ³ ¹ and fractions numbers.
_UPPER_CLASS = np.array([_OTHER] * 64 + [_LETTER] * 64, np.uint8)
_UPPER_CLASS[[0x05, 0x20]] = _ODD
_UPPER_CLASS[[0x2A, 0x35, 0x3A]] = _LETTER
_UPPER_CLASS[[0x32, 0x33, 0x39, 0x3C, 0x3D, 0x3E]] = _NUMBER
_UPPER_CLASS[[0x57, 0x77]] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordCoder:
    """The tokenizers library, asked once for each piece of a text.

    Pieces never reach over ASCII white space. Most words are of Latin-1 characters, whose normal form is their lower case;
    they are cut in pieces here, at changes of class, and the library's model gets the pieces that are new. Words with other
    characters, with white space beyond ASCII, with what may be a contraction or a special token go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"]["end_of_word_suffix"]
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level vocabularies
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden) if b != 10}
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.pieces, self.words = WordMemo(self.new_pieces), WordMemo(self.new_words)

    def new_pieces(self, missing: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All in one call, as words between line feeds: a piece's last token is one that ends words."""
        shown = b"\n".join(missing).decode("latin-1").translate(self.alphabet)
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(missing) or ends[-1] != len(ids) - 1:
            raise ValueError("the vocabulary doesn't end every word with a token of its own kind")
        return ids, np.diff(ends, prepend=-1)

    def new_words(self, missing: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        place: dict[bytes, int] = {}
        which = [place.setdefault(w, len(place)) for w in missing]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in place], add_special_tokens=False)]
        sizes = np.fromiter((len(found[i]) for i in which), np.int64, len(which))
        return np.fromiter((x for i in which for x in found[i]), "<u4", int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        data, at = join([t.encode("utf-8", "replace") + b"\n" for t in texts])
        kind = _CLASS[data]
        lower = _LOWER[data]
        two = np.flatnonzero((data[:-1] & 0xFE) == 0xC2)
        second = data[two + 1]
        capital = (data[two] == 0xC3) & (second <= 0x9E) & (second != 0x97)
        lower[two + 1] = second + np.uint8(32) * capital
        kind[two] = kind[two + 1] = _UPPER_CLASS[(second & 0x3F) + np.where(data[two] == 0xC3, 64, 0)]
        odd = kind == _ODD
        quote = np.flatnonzero(data[:-1] == 39)
        odd[quote[np.isin(lower[quote + 1], np.frombuffer(b"strvmld", np.uint8))]] = True
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        change = np.empty(len(kind), bool)
        change[:1] = True
        change[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _NUMBER) & (data[1:] & 0xC0 != 0x80))
        start = np.flatnonzero(change)
        length = np.diff(start, append=len(kind))
        plain = kind[start] != _BLANK
        if odd.any():
            word, size = words(data)
            seen = np.concatenate([[0], np.cumsum(odd)])
            strange = seen[word + size] > seen[word]
            word, size = word[strange], size[strange]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[word], inside[word + size] = 1, -1  # words don't touch
            plain &= np.cumsum(inside, dtype=np.int8)[start] == 0
        else:
            word = size = np.zeros(0, np.int64)
        start, length = start[plain], length[plain]
        ids, n = self.pieces.encode(lower, start, length)
        if len(word):
            more, m = self.words.encode(data, word, size)
            order = np.argsort(np.concatenate([start, word]), kind="stable")
            first = np.concatenate([np.cumsum(n) - n, len(ids) + np.cumsum(m) - m])[order]
            start, n = np.concatenate([start, word])[order], np.concatenate([n, m])[order]
            ids = np.concatenate([ids, more])[ragged(first, n)]
        before = np.concatenate([[0], np.cumsum(n)])
        cuts = (before[np.searchsorted(start, at)] * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_loaded: dict[str, WordCoder] = {}


def load(path: str) -> WordCoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are dealt out by Spark
    if path not in _loaded:
        _loaded[path] = WordCoder(path)
    return _loaded[path]


def encode_ids(docs: DataFrame, file: str = "word_bpe_49k.json", end: int = END_ID) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers, the end id last) of the whole text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = load(vocabulary(file)), struct.pack("<I", end)
        for part in slices(batches):
            ids = [x + last for x in coder.encode([t or "" for t in part.column("text").to_pylist()])]
            yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def train_dictionary(docs: DataFrame, file: str, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary trained on the ids of `sample` documents, those of least hash; empty if there is too little."""
    ids = pick(docs, "doc_id").filter("doc_id IS NOT NULL").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    few = ids.filter(F.col("h") <= int((1 << 30) * min(1.0, (2 * sample + 100) / max(1, docs.count()))))
    chosen = few.distinct().orderBy("h", "doc_id").limit(sample).select("doc_id")
    texts = pick(docs, "doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    # A document adds what fits the trainer: its ids are cut in samples of at most 16 kB, 4 of them from long ones.
    pieces = encode_ids(texts, file).select(F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(3), F.floor(F.length("ids") / 16384).cast("int"))), lambda k: F.col("ids").substr(k * 16384 + 1, F.lit(16384)))).alias("piece"))
    samples = sorted(bytes(r.piece) for r in pieces.collect() if r.piece)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


#: A row's place in the order of a file set, as numpy compares it: nulls first, then doc_id, the text's hash, a random number.
ORDER = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("tie", "<i8"), ("salt", "<i8")])
#: Rows that are looked at to cut the doc_ids into ranges of about equal numbers, for each range and in all.
LOOKS, MOST_LOOKS = 40, 1_000_000


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"tie": F.xxhash64("text"), "salt": (F.rand(3) * float(1 << 62)).cast("long")})


def _order(doc_id: pa.Array, tie: pa.Array, salt: pa.Array) -> np.ndarray:
    out = np.empty(len(doc_id), ORDER)
    out["known"], out["doc_id"] = ~np.asarray(doc_id.is_null().to_numpy(zero_copy_only=False)), doc_id.fill_null(0).to_numpy()
    out["tie"], out["salt"] = tie.to_numpy(), salt.to_numpy()
    return out


def range_bounds(docs: DataFrame, n: int) -> np.ndarray:
    """The n - 1 places at which the order is cut, found from a sample of doc_ids alone.

    A doc_id with so many rows that several cuts fall on it is cut further by the hashes of its texts, and equal texts by chance.
    """
    low = np.iinfo(np.int64).min
    rows = pick(docs, "doc_id", "text")
    looks = min(LOOKS * n, MOST_LOOKS)
    share = min(1.0, looks / max(1, docs.count()))
    seen = sorted((r[0] is not None, r[0] or 0) for r in rows.select("doc_id").sample(share, 5).collect())
    cuts = [seen[len(seen) * k // n] for k in range(1, n)] if seen else []
    hot = {c: k for c in set(cuts) if (k := cuts.count(c)) > 1}
    inner: dict[tuple, list] = {c: [] for c in hot}
    if hot:
        named = F.col("doc_id").isin([d for known, d in hot if known]) | (F.col("doc_id").isNull() if (False, 0) in hot else F.lit(False))
        for r in _keyed(rows.filter(named)).select("doc_id", "tie", "salt").sample(share, 6).collect():
            inner[r[0] is not None, r[0] or 0].append((r["tie"], r["salt"]))
    out = []
    for c in dict.fromkeys(cuts):
        own = sorted(inner.get(c, []))
        k = hot.get(c, 1)
        out += [(*c, *own[len(own) * i // (k + 1)]) for i in range(1, k + 1)] if own else [(*c, low, low)] * k
    return np.array(out, ORDER)


def write_ids(docs: DataFrame, path: str, file: str = "word_bpe_49k.json", end: int = END_ID, shard_bytes: int = SHARD_BYTES, ranges: int | None = None) -> None:
    """Encodes every whole text and writes the file set at path.

    Texts are encoded and compressed where they are read; frames alone are exchanged, each to its range of doc_ids. There are
    `ranges` of them, as many as Spark's shuffle partitions if not given.
    """
    spark = docs.sparkSession
    shared = train_dictionary(docs, file)
    digest = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(digest, bytearray(shared))], "dictionary_sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")
    n_ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, n_ranges)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = load(vocabulary(file)), struct.pack("<I", end)
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared), write_content_size=True)
        for part in slices(batches):
            to = np.searchsorted(bounds, _order(part.column("doc_id"), part.column("tie"), part.column("salt")), "right")
            ids = [x + last for x in coder.encode([t or "" for t in part.column("text").to_pylist()])]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            yield pa.record_batch([pa.array(to.astype(np.int32)), part.column("doc_id"), part.column("tie"), pa.array(n), pa.array([tool.compress(x) for x in ids], pa.binary())], ["range", "doc_id", "tie", "n", "frame"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = start = shard = 0
        names = ["range", "shard", "first_doc", "last_doc", "doc_ids", "frame_ends", "n_tokens", "starts", "frames", "dictionary_sha256", "range_tokens"]

        def flush() -> pa.RecordBatch:
            doc_ids, n, frames = zip(*held, strict=True)
            counts = np.array(n, np.int64)
            starts = start + np.cumsum(counts) - counts
            known = [d for d in doc_ids if d is not None]
            row = [[held_range], [shard], [min(known, default=None)], [max(known, default=None)], [list(doc_ids)], [np.cumsum([len(x) for x in frames]).tolist()], [list(n)], [starts.tolist()], [b"".join(frames)], [digest], [int(counts.sum())]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        held_range = None
        for batch in batches:
            for place, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "n", "frame")), strict=True):
                if held and (size + len(frame) > shard_bytes or place != held_range):
                    out = flush()
                    yield out
                    start += out.column("range_tokens")[0].as_py()
                    held, size, shard = [], 0, shard + 1
                if place != held_range:
                    held_range, start, shard = place, 0, 0
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield flush()

    frames = _keyed(pick(docs, "doc_id", "text")).mapInArrow(press, "range int, doc_id long, tie long, n long, frame binary")
    ordered = frames.repartitionById(n_ranges, "range").sortWithinPartitions("range", "doc_id", "tie").select("range", "doc_id", "n", "frame")
    shards = ordered.mapInArrow(gather, "range int, shard int, first_doc long, last_doc long, doc_ids array<long>, frame_ends array<long>, n_tokens array<long>, starts array<long>, frames binary, dictionary_sha256 string, range_tokens long")
    # Small row groups: a shard's row is large, and a reader of one document should find its row alone.
    writer = shards.write.option("compression", "none").option("parquet.block.size", 4 * shard_bytes)
    writer.option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(f"{path}/shards")
    index = spark.read.parquet(f"{path}/shards")
    index.groupBy("range").agg(F.sum("range_tokens").alias("tokens")).coalesce(1).write.parquet(f"{path}/ranges")


def range_starts(spark: SparkSession, path: str) -> DataFrame:
    """range, base: the ids in all earlier ranges. There is a row for each partition of the writing job, not more."""
    rows = sorted((r["range"], r["tokens"]) for r in spark.read.parquet(f"{path}/ranges").collect())
    bases = np.cumsum([0, *(n for _, n in rows)]).tolist()
    return spark.createDataFrame([(k, b) for (k, _), b in zip(rows, bases, strict=False)], "range int, base long")


#: doc_ids of one reading that are looked for one by one; more of them are looked for between the least and the largest.
FEW = 64


def shards_of(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The shards, or those that may hold some documents; first_doc and last_doc are compared, so the files' statistics count."""
    shards = spark.read.parquet(f"{path}/shards")
    if doc_ids is None:
        return shards
    wanted = sorted(set(doc_ids))
    spans = [(d, d) for d in wanted] if len(wanted) <= FEW else [(wanted[0], wanted[-1])]
    holds = F.lit(False)
    for a, b in spans:
        holds |= (F.col("first_doc") <= F.lit(b).cast("long")) & (F.col("last_doc") >= F.lit(a).cast("long"))
    return shards.filter(holds)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids as the files have them; all documents, or a few whose frames alone are opened."""
    found = spark.read.parquet(f"{path}/dictionary").first()
    digest, shared = found["dictionary_sha256"], bytes(found["dictionary"])
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hashlib.sha256(shared).hexdigest() != digest:
            raise ValueError("the dictionary isn't the one that its hash names")
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(shared))
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in ("base", "doc_ids", "frame_ends", "starts", "frames", "dictionary_sha256")}
                if row["dictionary_sha256"].as_py() != digest:
                    raise ValueError("this shard was written with another dictionary")
                frames, ids_of = memoryview(row["frames"].as_buffer()), row["doc_ids"].as_py()
                begins = [0, *row["frame_ends"].as_py()]
                starts = row["base"].as_py() + row["starts"].values.to_numpy()
                some = [i for i, d in enumerate(ids_of) if wanted is None or d in wanted]
                for k in range(0, len(some), 1000):
                    part = some[k : k + 1000]
                    ids = [opener.decompress(frames[begins[i] : begins[i + 1]]) for i in part]
                    yield pa.record_batch([pa.array([ids_of[i] for i in part], pa.int64()), pa.array(starts[part]), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    rows = shards_of(spark, path, doc_ids).select("range", "doc_ids", "frame_ends", "starts", "frames", "dictionary_sha256")
    return rows.join(F.broadcast(range_starts(spark, path)), "range").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
