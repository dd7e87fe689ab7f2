"""Spelling variants: words of the corpus at edit distance one, by a self-join of their tries, and the form that each leads to.

Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, LEAST_LENGTH code points or more, found
LEAST_COUNT times or more in all texts. Tasks count the runs of their documents before the shuffle.

Two near words of m and m or m + 1 code points agree in their first h = m // 2 or in their last m - h. So the vocabulary is
dealt to tries by the length m with a prefix, and by m with a suffix; a trie holds what is left of its words, those of
length m and those of m + 1. A group that is larger than SPLIT words is dealt further by the halves of what is left of it,
until each fits: one code point left bounds a group. Pairs that agree in the prefix belong to the trie of the prefix alone.

In a trie, near words part at one node, where the whole distance is spent. From each such node on, the nodes active for one
another are pairs of its children: both one level down for a replaced code point, one of them a level ahead for an inserted
one. Pairs go down together by equal code points, and those that end together are near words. Sorted, a set of words is its
trie: a node is a range with a common prefix, and common prefixes of neighbours tell where ranges part.

Nulls and empty texts have no words. Very long texts are read whole; very long words count like others. Rows that repeat a
doc_id are documents of their own; a null doc_id is as the empty text. Ties of the form go to the smallest word in code-point
order. An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, pick, slices

LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_ONE_IN = 97
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words of a group above which it is dealt further (with one code point left it has 90 + 90 * 90 at most), words of the tries
#: that a task joins at a time and their bytes, which bound a group too, and pairs of nodes that go down together.
SPLIT = 50_000
CHUNK_WORDS, CHUNK_BYTES = 100_000, 16 << 20
PAIRS = 200_000
_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST_LENGTH)


def counts(text: str | None, doc_id: int | None) -> Counter[str]:
    """How often each word of LEAST_LENGTH or more stands in a text, after one code point of some runs has been dropped."""
    text = text or ""
    # In UTF-8, bytes.lower changes A-Z only.
    found = Counter(_RUN.findall(text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode()))
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    dropped: Counter[str] = Counter()
    for run in list(found):
        h = zlib.crc32(run.encode(), head)
        if h % DROP_ONE_IN == 0:
            n, i = found.pop(run), h % len(run)
            if len(run) > LEAST_LENGTH:
                dropped[run[:i] + run[i + 1 :]] += n
    return found + dropped


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all documents and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                held.update(counts(text, doc_id))
                if len(held) > COUNTED:
                    yield told()
                    held.clear()
        if held:
            yield told()

    found = pick(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Tries:
    """Sorted words below several roots, numbered by `group`; pairs that part at a depth of `limit` or more aren't a root's own."""

    def __init__(self, words: list[bytes], group: np.ndarray, limit: np.ndarray):
        sizes = np.array([len(w) for w in words])
        self.width = int(sizes.max()) + 2
        flat = np.frombuffer(b"".join(words), np.uint8)
        self.codes = np.zeros((len(words), self.width), np.uint8)
        self.codes[np.repeat(np.arange(len(words)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        self.sizes, self.limit = sizes, limit
        differ = self.codes[1:] != self.codes[:-1]
        common = np.where(group[1:] == group[:-1], differ.argmax(1), -1)
        #: Code points that a word shares with the one before it, -1 for a root's first.
        self.common = np.concatenate([[-1], common])
        self.parted: dict[int, np.ndarray] = {}

    def starts(self, depth: int) -> np.ndarray:
        """Where the nodes begin that stand one level below `depth`."""
        if depth not in self.parted:
            if len(self.parted) > 60:
                self.parted.clear()
            self.parted[depth] = np.flatnonzero(self.common <= depth)
        return self.parted[depth]

    def children(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner (its number among the nodes), lo and hi of the children of nodes at a depth, in order."""
        starts = self.starts(depth)
        first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        n = last - first
        owner = np.repeat(np.arange(len(lo)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
        begin = starts[at]
        end = np.minimum(np.append(starts, len(self.codes))[at + 1], hi[owner])
        return owner, begin, end

    def descend(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ahead: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words below pairs of active nodes that are equal from there on; a's nodes are at `depth`, b's `ahead` levels further."""
        stack = [(a[0], a[1], b[0], b[1], depth)]
        while stack:
            a0, a1, b0, b1, depth = stack.pop()
            if len(a0) > PAIRS:
                stack += [(a0[k : k + PAIRS], a1[k : k + PAIRS], b0[k : k + PAIRS], b1[k : k + PAIRS], depth) for k in range(0, len(a0), PAIRS)]
                continue
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                yield self.equal(a0[single], b0[single], depth, ahead)
                a0, a1, b0, b1 = (x[~single] for x in (a0, a1, b0, b1))
            if not len(a0) or depth + ahead >= self.width:
                continue
            of_a, alo, ahi = self.children(a0, a1, depth)
            of_b, blo, bhi = self.children(b0, b1, depth + ahead)
            key_a = of_a * 256 + self.codes[alo, depth]
            key_b = of_b * 256 + self.codes[blo, depth + ahead]
            at = np.minimum(np.searchsorted(key_b, key_a), max(len(key_b) - 1, 0))
            hit = np.flatnonzero(key_b[at] == key_a) if len(key_b) else np.zeros(0, np.int64)
            if len(hit):
                stack.append((alo[hit], ahi[hit], blo[at[hit]], bhi[at[hit]], depth + 1))

    def equal(self, a: np.ndarray, b: np.ndarray, depth: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
        fit = self.sizes[b] == self.sizes[a] + ahead
        a, b = a[fit], b[fit]
        step, same = max(1, CHUNK_BYTES // self.width), np.zeros(len(a), bool)
        for k in range(0, len(a), step):
            x, y = self.codes[a[k : k + step], depth : self.width - ahead], self.codes[b[k : k + step], depth + ahead :]
            same[k : k + step] = (x == y).all(1)
        return a[same], b[same]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of near words; the first isn't longer."""
        for depth in np.unique(self.common[self.common >= 0]).tolist():
            starts = np.flatnonzero(self.common < depth)
            ends = np.append(starts[1:], len(self.codes))
            parts = np.add.reduceat(self.common == depth, starts) > 0
            parts &= self.limit[starts] > depth
            lo, hi = starts[parts], ends[parts]
            for k in range(0, len(lo), 1000):
                owner, begin, end = self.children(lo[k : k + 1000], hi[k : k + 1000], depth)
                code = self.codes[begin, depth]
                n = np.bincount(owner)
                # Ordered pairs of different children of one node: x's code point, or its end, stands where y has another.
                x = np.repeat(np.arange(len(owner)), n[owner])
                first = (np.cumsum(n) - n)[owner]
                y = np.arange(len(x)) - np.repeat(np.cumsum(n[owner]) - n[owner], n[owner]) + first[x]
                keep = (x != y) & (code[y] != 0)
                x, y = x[keep], y[keep]
                both = (x < y) & (code[x] != 0)
                yield from self.descend((begin[x[both]], end[x[both]]), (begin[y[both]], end[y[both]]), 0, depth + 1)
                yield from self.descend((begin[x], end[x]), (begin[y], end[y]), 1, depth)


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of words (word, n) at distance one, once; a isn't longer than b."""
    size = F.char_length("word")
    kept = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LENGTH)).alias("m"))
    at = ["m", "limit", "prefix", "suffix"]
    start = kept.select("m", F.lit(0).alias("limit"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.col("word").alias("middle"), "n")
    rows, found = start, None
    while rows is not None:
        dealt = halves(rows)
        groups = dealt.groupBy(*at).agg(F.count("*").alias("n_words"), F.max(F.char_length("middle")).alias("longest"))
        large = (F.col("n_words") > SPLIT) | (F.col("n_words") * F.col("longest") > CHUNK_BYTES)
        hot = cut(groups.filter(large & (F.col("n_words") > 1) & (F.col("longest") > 2)).select(*at))
        rows = None
        if hot.limit(1).count():
            rows = cut(dealt.join(hot, at, "left_semi"))
            dealt = dealt.join(hot, at, "left_anti")
        ordered = dealt.repartition(*at).sortWithinPartitions(*at, "middle")
        pairs = ordered.select(*at, "middle", "n").mapInArrow(_join, "a string, n_a long, b string, n_b long")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def halves(rows: DataFrame) -> DataFrame:
    """Each group's words by the first half of their middles, and by the second.

    m is the shorter length of the group's pairs. `limit`, if above 0, says that pairs which agree in so many code points
    belong elsewhere: to the trie of that prefix.
    """
    p, s = F.char_length("prefix"), F.char_length("suffix")
    left = F.col("m") - p - s
    half = F.floor(left / 2).cast("int")
    size = F.char_length("middle")
    first = F.struct(F.col("limit").alias("limit"), F.concat("prefix", F.substr("middle", F.lit(1), half)).alias("prefix"), F.col("suffix").alias("suffix"), F.substr("middle", half + 1).alias("middle"))
    rest = left - half
    second = F.struct((p + half).alias("limit"), F.col("prefix").alias("prefix"), F.concat(F.substr("middle", size - rest + 1), F.col("suffix")).alias("suffix"), F.substr("middle", F.lit(1), size - rest).alias("middle"))
    return rows.select("m", "n", F.explode(F.array(first, second)).alias("to")).select("m", "to.limit", "to.prefix", "to.suffix", "to.middle", "n")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of groups that come sorted; a number of whole groups at a time."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [r[:4] for r in rows]
        group = np.cumsum([i > 0 and keys[i] != keys[i - 1] for i in range(len(rows))])
        limit = np.array([r[1] - len(r[2]) if r[1] else 1 << 40 for r in rows])
        tries = Tries([r[4].encode("latin-1") for r in rows], group, limit)
        whole = [r[2] + r[4] + r[3] for r in rows]
        n = np.array([r[5] for r in rows])
        fits = np.array([len(w) for w in whole]) == np.array([r[0] for r in rows])
        for a, b in tries.near():
            own = fits[a]  # pairs of the longer length are found where it is the shorter one
            a, b = a[own], b[own]
            if len(a):
                yield pa.record_batch([pa.array([whole[i] for i in a.tolist()], pa.string()), pa.array(n[a]), pa.array([whole[i] for i in b.tolist()], pa.string()), pa.array(n[b])], ["a", "n_a", "b", "n_b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= CHUNK_WORDS or (len(held) + 1) * max(size, len(row[4])) > CHUNK_BYTES) and row[:4] != held[-1][:4]:
                yield from solve(held)
                held, size = [], 0
            held.append(row)
            size = max(size, len(row[4]))
    if held:
        yield from solve(held)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to, by doubled steps; a form is commoner than its word, so they end."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("behind"))
        joined = cut(steps.join(further, "root", "left").select("word", F.coalesce("behind", "root").alias("root"), F.col("behind").isNotNull().alias("moved")))
        steps = joined.select("word", "root")
        if not joined.filter("moved").limit(1).count():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut(vocabulary(docs))
    pairs = near_words(words)
    seen = lambda word, n, w: F.struct(F.col(word).alias("word"), F.struct((-F.col(n)).alias("n"), F.col(w).alias("w")).alias("other"))
    both = pairs.select(F.explode(F.array(seen("a", "n_b", "b"), seen("b", "n_a", "a"))).alias("x")).select("x.word", "x.other")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    led = -F.col("best.n") >= 2 * F.col("n")
    found = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.w")).alias("form"), F.when(led, -F.col("best.n")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
