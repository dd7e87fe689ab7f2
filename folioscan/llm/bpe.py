"""Byte-level BPE by rank: pieces of equal length class are merged together as padded numpy matrices.

`encode_documents` and `decode_documents` are map-only; a document with null or empty text has no ids. Very long texts are
encoded whole; a piece of more than WIDEST bytes (few texts have one) is merged with a heap, since a matrix row takes a round
for each of its merges and each round its whole width. Repeated rows are encoded like any other, and ties in rank go to the
leftmost pair. An empty table gives no rows; other columns, also with clashing names, don't matter.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pick, slices

NONE = np.int32(0x7FFFFFFF)
#: Pieces of more bytes are merged with a heap instead of a matrix row.
WIDEST = 256
#: Entries that a worker's memo of chunks holds at most, and characters of a chunk that is kept.
MEMO, KEPT = 200_000, 32
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts where the piece pattern always cuts too: each chunk holds whole pieces.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class PairTable:
    """(left id, right id) -> merged id, as an open-addressed hash table that is probed in numpy."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.EMPTY)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        merged = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == self.EMPTY
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], merged[put]
            keys, merged, slot = keys[~put], merged[~put], (slot[~put] + ~free[~put]) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.FACTOR) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where a pair doesn't merge or has a negative id."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != self.EMPTY)]
        return np.where((left < 0) | (right < 0), NONE, out)


class RankBPE:
    """Encoder and decoder of a rank file: lines of base64 token and rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a, b] = i
        self.pairs, self.table = pairs, PairTable(pairs)
        self.memo: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > WIDEST):
            out[i] = self._merge_long(pieces[i])
        classes = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(classes[(lengths > 0) & (lengths <= WIDEST)]):
            rows = np.flatnonzero(classes == width)
            step = max(1, (1 << 20) // int(width))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part.tolist(), self._merge_matrix([pieces[i] for i in part], int(width)), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Every row merges its leftmost pair of least rank each round; rows without one leave the matrix."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < length[:, None], self.bytes[raw], -1)
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while True:
            if rank.shape[1]:
                at = rank.argmin(1)
                best = rank[np.arange(len(row)), at]
                live = best != NONE
            else:
                live = np.zeros(len(row), bool)
            if not live.all():
                done = np.ascontiguousarray(ids[~live].astype("<u4"))
                for i, k, n in zip(row[~live].tolist(), range(len(done)), length[~live].tolist(), strict=True):
                    out[i] = done[k, :n].tobytes()
                if not live.any():
                    return out
                ids, rank, row, length, at, best = ids[live], rank[live], row[live], length[live], at[live], best[live]
            # The merged id replaces the pair, and what stands behind it moves one place to the left.
            n, w = ids.shape
            columns = np.arange(w - 1)
            moved = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            every = np.arange(n)
            moved[every, at] = best
            length -= 1
            if w == 2:
                ids, rank = moved, rank[:, :0]
                continue
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), 1)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.table.get(moved[before, at[before] - 1], moved[before, at[before]])
            after = np.flatnonzero(at < w - 2)
            rank[after, at[after]] = self.table.get(moved[after, at[after]], moved[after, at[after] + 1])
            ids = moved
            if (most := int(length.max())) < w - 2:
                ids, rank = ids[:, :most], rank[:, : most - 1]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges over a linked list with a heap, in n log n steps."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(r, i) for i, x in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.pairs.get(x)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        chunks = [CHUNK.findall(t) for t in texts]
        memo, rare = self.memo, {}
        if missing := list({c for found in chunks for c in found if c not in memo}):
            cuts = [self.pattern.findall(c) for c in missing]
            pieces = list({p for found in cuts for p in found})
            ids = dict(zip(pieces, self.merge([p.encode() for p in pieces]), strict=True))
            for c, found in zip(missing, cuts, strict=True):
                rare[c] = ids[found[0]] if len(found) == 1 else b"".join([ids[p] for p in found])
        out = [b"".join([memo[c] if c in memo else rare[c] for c in found]) for found in chunks]
        if len(memo) + len(rare) > MEMO:
            memo.clear()
        for c, x in zip(rare, rare.values(), strict=True):
            if len(c) <= KEPT and len(memo) < MEMO:
                memo[c] = x
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], RankBPE] = {}


def load(path: str, pattern: str) -> RankBPE:
    """One encoder for each file and worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = RankBPE(path, pattern)
    return _loaded[path, pattern]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, file: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of the whole text of every row.

    Null and empty texts have no ids. Rows of the input map one to one; other columns don't matter. With decode, `decoded`
    (binary) has the bytes that the ids stand for, in the same pass and by the same worker's tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = load(vocabulary(file), pattern or public_tokenizers.PATTERN)
        for part in slices(batches, most=1 << 20):
            ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
            columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([coder.decode(x) for x in ids], pa.binary()))
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])
        coder.memo.clear()  # the worker may run other stages next, which need its memory

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, file: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """The rows of `encode_documents` with `decoded` (binary), the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = load(vocabulary(file), pattern or public_tokenizers.PATTERN)
        for part in slices(batches, "ids"):
            yield pa.record_batch([*part.columns, pa.array([coder.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary())], [*part.schema.names, "decoded"])

    return pick(encoded, "doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    rows = encode_documents(documents(spark, sf_dir), decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
