"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of their binary trie.

Two fingerprints link if they differ in at most BUDGET = 3 of 64 bits. Then at least one of their four quarters is equal,
so the join runs over four tries, each with another quarter in front: below an equal quarter, pairs of nodes go down
together, the bits in which they differ add up, and a pair is dropped as soon as the sum exceeds the budget. A subtree
whose leaves are already linked with each other is not paired again, so large groups of near copies cost no more than
their links. Sorted, a set of fingerprints is its trie: a node is a range with a common prefix.

Distinct fingerprints alone are joined, so copies cost nothing; a task holds whole quarters, as many at a time as make CHUNK
fingerprints. What stands below one quarter and is more than SPLIT, of which each takes some 100 bytes in a task, is dealt to
tasks by pairs of subtrees SPLIT_BITS further down, and again if such a pair is too large. Links are reduced to spanning trees
where they are found, and components follow by contracting stars, with checkpoints. Nothing but counts comes to the driver.

Null and empty texts have fingerprint zero and link like any other; very long ones are read whole. Bits set in exactly half of
the shingles are 0. Rows that repeat a doc_id keep a row each. A null doc_id stays; a component's id is its smallest doc_id,
null if it has none. An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, pick, slices

BUDGET, QUARTER = 3, 16
#: Fingerprints that a task joins at a time, and those below one quarter, or one pair of subtrees, above which it is split.
CHUNK = 200_000
SPLIT = 500_000
#: Bits further down of the subtrees that are paired then.
SPLIT_BITS = 8
#: Node pairs that go down together.
PAIRS = 400_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SWAP = {ord(c): " " for c in "\t\n\v\f\r"}


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits; one is set if it is in over half of the shingles' XXH64, repeats included."""
    found = [w for w in (text or "").translate(_SWAP).split(" ") if w]
    if not found:
        return 0
    lower = [w.translate(_LOWER) if not w.isascii() else w.lower() for w in found]
    rest = [lower[k:] for k in range(min(words, len(lower)))]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(" ".join(s).encode("utf-8", "replace"), seed) for s in zip(*rest, strict=False)], np.uint64)
    return bits_over_half(h)


def bits_over_half(h: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of the whole text of every row, and its longs `also`; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([part.column("doc_id"), pa.array(found.view(np.int64)), *(part.column(c) for c in also)], ["doc_id", "fp", *also])

    return pick(docs, "doc_id", "text", *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


class Forest:
    """Components of the leaves seen so far; labels are the smallest leaf."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._turns: np.ndarray | None = None

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.label[a], self.label[b]
            live = a != b
            a, b = a[live], b[live]
            if not len(a):
                return
            self._turns = None
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def turns(self) -> np.ndarray:
        """How often the label has changed up to each leaf: equal at both ends of a range of one component."""
        if self._turns is None:
            self._turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return self._turns


def join_trie(keys: np.ndarray, roots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], first_bit: int) -> np.ndarray:
    """The component label of each of the sorted keys, linked where two below a pair of roots differ in BUDGET bits at most.

    roots: ranges (lo, hi) of both nodes of each pair, and the bits in which they differ already. first_bit: the highest
    bit on which the roots' leaves may differ, 63 at most.
    """
    forest = Forest(len(keys))
    # Leaves that differ in one bit are linked first, so that subtrees of one component can be passed over.
    for bit in range(first_bit + 1) if len(keys) else ():
        other = keys ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == other) & (at > np.arange(len(keys))))
        if len(hit):
            forest.link(hit, at[hit])
    stack = [(*(np.asarray(x) for x in roots), first_bit)]
    while stack:
        a0, a1, b0, b1, diff, bit = stack.pop()
        if len(a0) > PAIRS:
            for k in range(0, len(a0), PAIRS):
                stack.append((a0[k : k + PAIRS], a1[k : k + PAIRS], b0[k : k + PAIRS], b1[k : k + PAIRS], diff[k : k + PAIRS], bit))
            continue
        # Pairs within one component, and a single leaf with itself, have nothing to add.
        turns = forest.turns()
        one = (forest.label[a0] == forest.label[b0]) & (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0])
        a0, a1, b0, b1, diff = (x[~one] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        # Small pairs of nodes: their leaves are compared.
        small = (a1 - a0) * (b1 - b0) <= 16
        if bit < 0:
            small[:] = True
        if small.any():
            n, m = a1[small] - a0[small], b1[small] - b0[small]
            which = np.repeat(np.arange(len(n)), n * m)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            x, y = a0[small][which] + at // m[which], b0[small][which] + at % m[which]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= BUDGET)
            forest.link(x[near], y[near])
            a0, a1, b0, b1, diff = (v[~small] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        # Both nodes are cut at the next bit: the first leaf of each that has it set.
        one_bit, below = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        am, bm = (np.clip(np.searchsorted(keys, (keys[lo] | one_bit) & ~below), lo, hi) for lo, hi in ((a0, a1), (b0, b1)))
        same = a0 == b0
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        cross = ~same
        parts.append((am[cross], a1[cross], b0[cross], bm[cross], diff[cross] + 1))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= BUDGET)
        stack.append((*(x[live] for x in joined), bit - 1))
    return forest.label


def rotate(fp: np.ndarray, quarter: int) -> np.ndarray:
    """The fingerprint with one of its quarters in front."""
    k = np.uint64(QUARTER * quarter)
    return fp if not quarter else (fp << k) | (fp >> (np.uint64(64) - k))


def back(keys: np.ndarray, quarter: int) -> np.ndarray:
    return rotate(keys, (4 - quarter) % 4)


def links_of(keys: np.ndarray, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (as fingerprints) among sorted keys that share their first QUARTER bits with others."""
    front = keys >> np.uint64(64 - QUARTER)
    starts = np.flatnonzero(np.concatenate([[True], front[1:] != front[:-1]]))
    ends = np.append(starts[1:], len(keys))
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    label = join_trie(keys, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)), 63 - QUARTER)
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return back(keys[moved], quarter), back(keys[label[moved]], quarter)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near(distinct: DataFrame) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) that give the components of all links."""
    quarters = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    turned = F.expr("CASE q WHEN 0 THEN fp WHEN 1 THEN shiftleft(fp, 16) | shiftrightunsigned(fp, 48) WHEN 2 THEN shiftleft(fp, 32) | shiftrightunsigned(fp, 32) ELSE shiftleft(fp, 48) | shiftrightunsigned(fp, 16) END")
    rows = quarters.select("q", turned.alias("key")).withColumn("front", F.shiftrightunsigned("key", 48).cast("int"))
    large = cut(rows.groupBy("q", "front").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT))
    usual = rows

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush(q: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            for quarter in np.unique(q).tolist():
                a, b = links_of(keys[q == quarter], quarter)
                if len(a):
                    yield _links(a, b)

        for batch in batches:
            held.append((batch.column("q").to_numpy(), batch.column("key").to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size >= CHUNK:
                q, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                group = q.astype(np.int64) << QUARTER | (keys >> np.uint64(64 - QUARTER)).astype(np.int64)
                end = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
                if end:
                    yield from flush(q[:end], keys[:end])
                held, size = [(q[end:], keys[end:])], len(q) - end
        if size:
            q, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from flush(q, keys)

    if large.limit(1).count():
        hot = large.select("q", "front")
        usual = rows.join(hot, ["q", "front"], "left_anti")
        extra = split_links(rows.join(hot, ["q", "front"], "left_semi"))
    else:
        extra = None
    # Unsigned order of the key, as the trie needs it.
    ordered = usual.repartition("q", "front").sortWithinPartitions("q", "front", F.expr("key ^ (-9223372036854775807L - 1L)"))
    links = ordered.select("q", "key").mapInArrow(whole, "a long, b long")
    return links if extra is None else links.unionByName(extra)


def split_links(rows: DataFrame) -> DataFrame:
    """Links below large quarters (q, front, key), by pairs of subtrees ever further down, until each pair fits a task.

    A group is a pair of subtrees: `path` says which, `side` in which of the two a key stands, `used` in how many bits they
    differ; `cross` is false for a subtree with itself. A subtree is paired with those that BUDGET allows.
    """
    masks = F.array(*(F.lit(m) for m in range(1 << SPLIT_BITS) if bin(m).count("1") <= BUDGET))
    at = ["q", "front", "path"]
    rows = rows.select("q", "front", F.lit("").alias("path"), F.lit(0).alias("side"), F.lit(0).alias("used"), F.lit(False).alias("cross"), "key")
    found, depth = None, 0
    while rows is not None:
        depth += SPLIT_BITS
        child = F.shiftrightunsigned("key", 64 - QUARTER - depth).bitwiseAND((1 << SPLIT_BITS) - 1).cast("int")
        dealt = rows.withColumn("c", child).withColumn("m", F.explode(F.filter(masks, lambda m: F.bit_count(m) + F.col("used") <= BUDGET)))
        first = F.when(F.col("cross"), F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("c").bitwiseXOR(F.col("m")))).otherwise(F.least("c", F.col("c").bitwiseXOR(F.col("m"))))
        dealt = dealt.withColumn("first", first)
        side = F.when(F.col("cross"), F.col("side")).otherwise((F.col("c") != F.col("first")).cast("int"))
        path = F.concat("path", F.format_string("%02x%02x", "first", "m"))
        dealt = dealt.select("q", "front", path.alias("path"), side.alias("side"), (F.col("used") + F.bit_count("m")).alias("used"), (F.col("cross") | (F.col("m") != 0)).alias("cross"), "key")
        rows = None
        if depth < 64 - QUARTER:
            groups = dealt.groupBy(*at).agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)
            hot = cut(groups.select(*at))
            if hot.limit(1).count():
                rows = cut(dealt.join(hot, at, "left_semi"))
                dealt = dealt.join(hot, at, "left_anti")
        links = _below(dealt, 64 - QUARTER - depth)
        found = links if found is None else found.unionByName(links)
    return found


def _below(dealt: DataFrame, bits: int) -> DataFrame:
    """Links of groups that fit a task; `bits` are left below their subtrees' roots."""

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(q: int, cross: bool, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            n, first = len(keys), (keys >> np.uint64(bits)) << np.uint64(bits)
            half = int(np.searchsorted(first, first[-1])) if cross else 0
            if cross and not half:
                return
            x = lambda v: np.array([v])
            roots = (x(0), x(half), x(half), x(n), x(int(first[0] ^ first[-1]).bit_count())) if cross else (x(0), x(n), x(0), x(n), x(0))
            label = join_trie(keys, roots, bits - 1)
            moved = np.flatnonzero(label != np.arange(n))
            if len(moved):
                yield _links(back(keys[moved], q), back(keys[label[moved]], q))

        group, held = None, []
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("q", "front", "path", "cross")), strict=True))
            keys = batch.column("key").to_numpy().view(np.uint64)
            cuts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if group is not None and group != ids[a]:
                    yield from solve(group[0], group[3], np.concatenate(held))
                    held = []
                group = ids[a]
                held.append(keys[a:b])
        if held:
            yield from solve(group[0], group[3], np.concatenate(held))

    ordered = dealt.repartition("q", "front", "path").sortWithinPartitions("q", "front", "path", F.expr("key ^ (-9223372036854775807L - 1L)"))
    return ordered.select("q", "front", "path", "cross", "key").mapInArrow(below, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """fp, root of every fingerprint that has a link: alternating large and small stars until nothing moves.

    Each round hangs the larger neighbours of a node, then the smaller ones, to its smallest neighbour. The result is
    checked for being a star forest by a count, so only a number comes to the driver.
    """
    stars = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        stars = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        # A star forest: no node has two parents, and no parent has one.
        parents = stars.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if not parents and not stars.join(stars.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return stars.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach), root (a fingerprint that names the component) and `also`
    of every row."""
    rows = cut(fingerprints(docs, *also))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near(distinct))
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = placed.join(roots.select(F.col("root")).distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("of_root"))
    named = placed.join(least, "root", "left").select("fp", F.coalesce("of_root", "least").alias("component_id"), "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", *also)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
