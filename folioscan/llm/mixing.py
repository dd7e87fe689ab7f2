"""Mixing sources to target weights, by blocks of words.

Every source's words are packed into blocks of `block` words, or of fewer in a source that has under FINE blocks, so that a
block is a small part of any source. A shard of the mix has `slots` slots; it draws how many of
them each source gets from a multinomial of the targets. Numbered through all shards, the draws of a source are its slots;
a source that drew more than its quota hands the surplus slots to those that drew fewer, so every source meets its target
to within two blocks. A source's k-th slot holds the block that a pseudorandom permutation of its blocks maps k to, with a new
permutation for each pass; the mix is the join of slots and blocks by (source, index). A quota is at most two passes.
Everything random is a hash of a seed, so reruns agree. The order of words in a source is that of (bucket, doc_id, size, row's
hash); rows that are equal in all columns may change places, which changes no result.

Null and empty texts have no words and take no place; a null source is a source of its own, the last; rows that repeat a
doc_id are packed, counted and mixed each for itself, also if all their columns are equal. A very long text is cut into
blocks like any other; an empty table gives no rows; columns with other names don't matter, and clashing ones stay. No table
of more than a row for each source or bucket is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, pick, slices

BLOCK = 64
#: Blocks that a source has at least, if it has so many words: the words of its blocks are fewer than BLOCK else.
FINE = 256
SLOTS = 4096
#: Rows of one source are dealt to so many buckets by hash; words are numbered within and over buckets.
BUCKETS = 4096
SHARE, MOST = 1.5, 2
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
#: Sources that a mix may have: their table is collected to the driver.
SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that each source should give: `share` of all sizes by weight, none above `most` times its size."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, open_, left = np.zeros(len(sizes)), size > 0, share * size.sum()
    while open_.any():
        part = np.where(open_, left * w / w[open_].sum(), 0)
        full = open_ & (part >= most * size)
        if not full.any():
            out[open_] = part[open_]
            break
        out[full] = most * size[full]
        left -= out[full].sum()
        open_ &= ~full
    return out.tolist()


def _round(x: np.ndarray, half: np.ndarray, mask: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Four rounds of a balanced Feistel network on numbers of 2 * half bits."""
    left, right = x >> half, x & mask
    for r in range(4):
        y = (right + key + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(31)
        y *= np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((y >> np.uint64(29)) & mask)
    return left << half | right


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The k-th element of a pseudorandom permutation of 0..n-1 for each row: a Feistel network, walked until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        with np.errstate(over="ignore"):
            out[todo] = _round(out[todo], half[todo], mask[todo], key[todo])
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """The tables of a mix of docs (doc_id, text, source); see `taken`, `slots`, `pieces`.

    Slots come from a small range of shards, so Spark would take them for small: joins with them are hinted not to broadcast.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, buckets: int = BUCKETS, seed: int = 1):
        self.block, self.n_slots, self.seed = block, slots, seed
        spark = docs.sparkSession
        sized = with_tie(docs).select("doc_id", "source", n_words(F.col("text")).alias("size"), "tie", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int").alias("bucket"))
        self.sized = cut(sized)
        # Words of each bucket of each source, numbered over buckets. A source has `buckets` rows here at most.
        each = self.sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = each.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0)))
        totals = [(r["source"], r["n"] or 0) for r in each.groupBy("source").agg(F.sum("n").alias("n")).limit(SOURCES + 1).collect()]
        if len(totals) > SOURCES:
            raise ValueError(f"a mix has at most {SOURCES} sources")
        totals.sort(key=lambda x: (x[0] is None, x[0] or ""))  # Python orders text by code point
        goal = targets([n for _, n in totals])
        widths = [max(1, min(block, n // FINE)) for _, n in totals]
        blocks = [-(-n // w) for (_, n), w in zip(totals, widths, strict=True)]
        quota = [0 if not n else min(MOST * b, int(t // n) * b + round(t % n / w)) for (_, n), t, b, w in zip(totals, goal, blocks, widths, strict=True)]
        self.table = [(i, s, n, t, w, b, q) for i, ((s, n), t, w, b, q) in enumerate(zip(totals, goal, widths, blocks, quota, strict=True))]
        self.sources = spark.createDataFrame(self.table, "k int, source string, source_size long, target double, width long, blocks long, quota long")
        self.starts = starts.select("source", "bucket", "base")
        self._placed: DataFrame | None = None

    def placed(self) -> DataFrame:
        """k, width, doc_id, tie, size, at: the place of every row's first word among its source's words, in blocks of width words.

        Rows without words are left out.
        """
        if self._placed is None:
            inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
            rows = self.sized.filter("size > 0").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.bucket") == F.col("r.bucket"))
            rows = rows.alias("l").join(self.starts.alias("r"), same).select("doc_id", "l.source", "size", "tie", (F.col("before") + F.col("base")).alias("at"))
            named = rows.alias("l").join(F.broadcast(self.sources.select("k", "source", "width")).alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
            self._placed = cut(named.select("k", "width", "doc_id", "tie", "size", "at"))
        return self._placed

    def pieces(self) -> DataFrame:
        """k, index, doc_id, tie, at, start, words: the part of a row (from word start) that a block holds."""
        named = self.placed()
        b = F.col("width")
        cuts = named.withColumn("index", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
        start = F.greatest(F.lit(0), F.col("index") * b - F.col("at"))
        end = F.least(F.col("size"), (F.col("index") + 1) * b - F.col("at"))
        return cuts.select("k", "index", "doc_id", "tie", "at", start.alias("start"), (end - start).alias("words"))

    def slots(self) -> DataFrame:
        """shard, k, pass, index: the blocks of every shard of the mix."""
        spark = self.sources.sparkSession
        quota = np.array([q for *_, q in self.table], np.int64)
        blocks = np.array([b for *_, b, _ in self.table], np.int64)
        all_slots, size, seed = int(quota.sum()), self.n_slots, self.seed
        shards = -(-all_slots // size)
        chance = quota / max(1, all_slots)

        def draw(shard: int) -> np.ndarray:
            n = min(size, all_slots - shard * size)
            return np.random.Generator(np.random.PCG64([seed, shard])).multinomial(n, chance)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    n = draw(shard)
                    k = np.flatnonzero(n)
                    yield pa.record_batch([pa.array(np.full(len(k), shard // GROUP)), pa.array(np.full(len(k), shard)), pa.array(k.astype(np.int32)), pa.array(n[k])], ["g", "shard", "k", "n"])

        drawn = cut(spark.range(0, shards, 1, max(1, min(shards, 64 + shards // 1000))).mapInArrow(count, "g long, shard long, k int, n long"))
        # Draws are numbered within a group of shards, and groups by their sums.
        groups = drawn.groupBy("g", "k").agg(F.sum("n").alias("n"))
        base = groups.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("g", "k", "base")
        inside = Window.partitionBy("g", "k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        numbered = drawn.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base.hint("merge"), ["g", "k"]).withColumn("first", F.col("first") + F.col("base"))
        totals = np.zeros(len(quota), np.int64)
        for r in groups.groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row for each source
            totals[r["k"]] = r["n"]
        over, under = np.maximum(totals - quota, 0), np.maximum(quota - totals, 0)
        over_at, under_at = np.cumsum(over) - over, np.cumsum(under)

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, k, n, first = (batch.column(c).to_numpy() for c in ("shard", "k", "n", "first"))
                own = np.repeat(k.astype(np.int64), n)
                number = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                # Surplus slots, numbered over all sources, go to the sources that drew too few.
                extra = number >= quota[own]
                rank = (over_at[own] + number - quota[own])[extra]
                to = np.searchsorted(under_at, rank, "right")
                own[extra], number[extra] = to, totals[to] + rank - (under_at - under)[to]
                turn = number // blocks[own]
                with np.errstate(over="ignore"):
                    key = (own.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + turn.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                index = permuted(number % blocks[own], blocks[own], key)
                yield pa.record_batch([pa.array(np.repeat(shard, n)), pa.array(own.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(index)], ["shard", "k", "pass", "index"])

        return numbered.select("shard", "k", "n", "first").mapInArrow(expand, "shard long, k int, pass int, index long")

    def join(self) -> DataFrame:
        """shard, k, pass, index, doc_id, tie, at, start, words: what the mix holds, piece by piece."""
        return self.slots().hint("merge").join(self.pieces(), ["k", "index"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for every row; taken counts the words that the mix takes, with repeats."""
        often = self.slots().groupBy("k", "index").agg(F.count("*").alias("times"))
        words = self.pieces().join(often.hint("merge"), ["k", "index"]).groupBy("k", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        some = self.placed().join(words, ["k", "at"], "left").join(F.broadcast(self.sources), "k")
        named = F.col("l.source").eqNullSafe(F.col("r.source"))
        empty = self.sized.filter("size = 0").alias("l").join(F.broadcast(self.sources).alias("r"), named).withColumn("taken", F.lit(0))
        columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
        return some.select(*columns).unionByName(empty.select(*columns))


#: Shards whose draws are numbered together.
GROUP = 256


def with_tie(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, and tie: a hash of all columns of the row, which tells rows of one doc_id apart."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.select(*(F.col(f"c{docs.columns.index(n)}").alias(n) for n in ("doc_id", "source", "text")), F.xxhash64(*plain.columns).alias("tie"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs' columns: for each row and pass the text of its words that were taken, if any.

    `text` keeps the words of a run of taken blocks as they stand; runs are joined by a line feed. `n_chars` is counted anew.
    """
    mix = Mix(docs, **options)
    runs = mix.join().groupBy("doc_id", "tie", "at", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("runs"))
    names, own_names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own_names).withColumn("own_tie", F.xxhash64(*own_names))
    own = own_names[names.index("doc_id")]
    if mix.placed().groupBy("doc_id", "tie").count().filter("count > 1").limit(1).count():
        # Rows that are equal in all columns: one of them stands for all, and has the places of each.
        plain = plain.groupBy(own, "own_tie").agg(*(F.first(c).alias(c) for c in own_names if c != own)).select(*own_names, "own_tie")
    rows = plain.join(runs, F.col(own).eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie"))).select(*own_names, "runs")
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    kinds = docs.toDF(*own_names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        # The words of the contract are those between ASCII blanks; a cut keeps the white space between its words.
        word = re.compile("[^ \t-\r]+")
        for part in slices(batches, f"c{text}"):
            texts = []
            for t, taken in zip(part.column(text).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                spans, out, end = [m.span() for m in word.finditer(t or "")], [], -1
                for r in taken:
                    a, b = r["start"], r["start"] + r["words"]
                    if a == end:
                        out[-1] = (out[-1][0], spans[b - 1][1])
                    else:
                        out.append((spans[a][0], spans[b - 1][1]))
                    end = b
                texts.append("\n".join(t[a:b] for a, b in out))
            new = {text: pa.array(texts, pa.string()), chars: pa.array(map(len, texts), pa.int64())}
            yield pa.record_batch([new.get(i, part.column(i)) for i in range(len(names))], own_names)

    return rows.mapInArrow(run, kinds).toDF(*names)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir)).taken()
