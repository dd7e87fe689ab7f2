"""A Merkle manifest of a dataset: a tree of SHA-256 digests over each source, and one over the sources' roots.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of a row's fields; BASE
consecutive nodes of a level become their H, the last run of a level with what it has, until one node is left.

The rows' digests, not their texts, are dealt to partitions by range of (source, doc_id), so a partition is a run of
consecutive leaves of each of its sources, and where it starts follows from the partitions' counts. Each task builds the
mountain range over its runs: it keeps the peaks of every level, hashes BASE of them as soon as they are a whole run, and
carries the node one level up. Nodes whose run reaches over an edge of the partition stay loose; loose nodes are few and are
merged level by level with those of the neighbours. The proof of a leaf needs the runs on its way to the root: a partition
has most of them, and is sent those that reach over its edges.

Nulls: a null field is `-`; null doc_ids and sources come first, as a source of their own. Null and empty texts differ in
their leaves. Very long texts are hashed whole. Rows of one doc_id are ordered by their digests; rows that agree in all
fields are leaves of their own with equal digests. A source that holds most rows takes many partitions, and so do rows that
are all equal. An empty table has no root and gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, pick

BASE = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a partition: at least, and at most beyond the session's shuffle partitions.
LEAST_RUN, MOST_RUN = 1_000, 250_000
#: Rows of proofs that a task gives at a time.
PROOFS = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_PATH = "array<struct<before: string, after: string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of the fields, each `-` or its UTF-8 length, a colon and its value; as 32 bytes."""
    told = (F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields))
    return F.unhex(F.sha2(F.concat(*told), 256))


class Peaks:
    """The mountain range over consecutive leaves: for each level, the nodes whose run isn't whole yet."""

    def __init__(self, start: int):
        self.next, self.levels = start, [[]]
        self.nodes: list[tuple[int, int, str]] = []
        self.loose: list[tuple[int, int, str]] = []
        self.top: tuple[int, int, str] | None = None

    def add(self, value: str) -> None:
        level, index = 0, self.next
        self.next += 1
        while True:
            if level == len(self.levels):
                self.levels.append([])
            run = self.levels[level]
            run.append((index, value))
            if index % BASE != BASE - 1:
                return
            self.levels[level] = []
            if run[0][0] % BASE:  # the run began in another partition
                self.loose += ((level, *x) for x in run)
                return
            level, index, value = level + 1, index // BASE, digest([x for _, x in run])
            self.nodes.append((level, index, value))

    def close(self, last: bool) -> None:
        """What is left: hashed if the source's last leaf has been added, loose otherwise."""
        level = 0
        while level < len(self.levels):
            run = self.levels[level]
            if last and run and level == len(self.levels) - 1 and [i for i, _ in run] == [0]:
                self.top = (level, *run[0])
            elif last and run and run[0][0] % BASE == 0:
                node = (run[0][0] // BASE, digest([x for _, x in run]))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(node)
                self.nodes.append((level + 1, *node))
            else:
                self.loose += ((level, *x) for x in run)
            level += 1


@dataclass
class Tree:
    """rows: leaves by partition; spans: where each source's leaves in a partition start; nodes: the records of the partitions;
    families: runs that reach over a partition's edge, with their parents; tops: the root of each source."""

    rows: DataFrame
    spans: DataFrame
    nodes: DataFrame
    families: DataFrame | None
    tops: DataFrame

    def records(self) -> DataFrame:
        """key, level, index and node of every node above the leaves."""
        kept = self.nodes.filter("level > 0").select("key", "level", "index", "node")
        return kept if self.families is None else kept.unionByName(self.families.select("key", (F.col("level") + 1).alias("level"), F.col("parent").alias("index"), "node"))


def grow(leaves: DataFrame) -> Tree:
    """The trees over leaves (key, ord, leaf and what else goes along), one for each key; leaves ascend by ord, then digest."""
    spark = leaves.sparkSession
    leaves = cut(leaves)
    count = leaves.count()
    parts = max(1, min(-(-count // LEAST_RUN), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // MOST_RUN))))
    # The number of a row only spreads rows that are equal in all else.
    numbered = leaves.withColumn("row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(parts, "key", "ord", "leaf", "row").sortWithinPartitions("key", "ord", "leaf")
    rows = cut(ranged.drop("row").withColumn("pid", F.spark_partition_id()))
    counts = rows.groupBy("pid", "key").agg(F.count("*").alias("n"))
    by_key = Window.partitionBy("key")
    start = F.coalesce(F.sum("n").over(by_key.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cut(counts.select("pid", "key", "n", start.alias("start"), F.sum("n").over(by_key).alias("total")))
    # A partition's first source may have begun before it, its last one may go on: two numbers a partition, on the driver.
    edges = spans.groupBy("pid").agg(F.max("start").alias("start"), F.max(F.when(F.col("start") + F.col("n") < F.col("total"), F.col("total"))).alias("total"))
    nodes = cut(_nodes(rows, {r["pid"]: (r["start"], r["total"]) for r in edges.collect()}))
    families, merged = _merge(nodes.filter("loose").select("key", "level", "index", "node", "total"))
    tops = nodes.filter("top").select("key", "node")
    return Tree(rows, spans, nodes, families, tops if merged is None else tops.unionByName(merged))


def _nodes(rows: DataFrame, edges: dict[int, tuple[int, int | None]]) -> DataFrame:
    """The records of each partition's mountain ranges."""
    schema = "pid int, key string, level int, index long, node binary, total long, loose boolean, top boolean"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peaks, key, pid = None, None, None

        def done(goes_on: int | None) -> Iterator[pa.RecordBatch]:
            peaks.close(goes_on is None)
            loose = set(peaks.loose)
            found = dict.fromkeys([*peaks.nodes, *peaks.loose, *([peaks.top] if peaks.top else [])])
            total = peaks.next if goes_on is None else goes_on
            out = [(pid, key, level, index, bytes.fromhex(x), total, (level, index, x) in loose, (level, index, x) == peaks.top) for level, index, x in found]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for p, k, x in zip(*(batch.column(c).to_pylist() for c in ("pid", "key", "leaf")), strict=True):
                if k != key or p != pid:
                    if peaks is not None:
                        yield from done(None if p == pid else edges[pid][1])
                    peaks = Peaks(edges[p][0] if p != pid else 0)
                    key, pid = k, p
                peaks.add(x.hex())
        if peaks is not None:
            yield from done(edges[pid][1])

    return rows.select("pid", "key", "leaf").mapInArrow(build, schema)


def _merge(loose: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The runs that reach over edges (key, level of the children, parent, kids, node), and the roots among their parents."""
    most = loose.agg(F.max("total")).first()[0]
    families = tops = above = None
    level = 0
    while most is not None and BASE**level < most:
        children = loose.filter(F.col("level") == level).drop("level")
        children = children if above is None else children.unionByName(above)
        kids = F.sort_array(F.collect_list(F.struct("index", "node")))
        found = children.groupBy("key", "total", F.shiftright("index", 4).alias("parent")).agg(kids.alias("kids"))
        told = F.array_join(F.transform("kids", lambda x: F.lower(F.hex(x["node"]))), "")
        found = cut(found.select("key", "total", F.lit(level).alias("level"), "parent", "kids", F.unhex(F.sha2(told, 256)).alias("node")))
        level += 1
        above = found.filter(F.col("total") > BASE**level).select("key", F.col("parent").alias("index"), "node", "total")
        roots = found.filter(F.col("total") <= BASE**level).select("key", "node")
        families = found if families is None else families.unionByName(found)
        tops = roots if tops is None else tops.unionByName(roots)
    return families, tops


def paths(tree: Tree, upper: DataFrame | None = None, *also: str) -> DataFrame:
    """ord, leaf (hex), path, and `also` of every leaf; `top` and the path's end come from upper (key, top, path), if given.

    A path has a step for each level: the digests of the run's nodes before and after, each as one text. H of before, own
    digest and after is the next level's.
    """
    spans = tree.spans
    # Runs over an edge that this partition's leaves stand below, on each level: at most two, its first and last.
    levels = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda x: F.pow(F.lit(BASE), x) < F.col("total"))
    asked = spans.select("pid", "key", "start", (F.col("start") + F.col("n") - 1).alias("end"), F.explode(levels).alias("level"))
    ends = F.array_distinct(F.array(*(F.expr(f"shiftright({c}, 4 * (level + 1))") for c in ("start", "end"))))
    context = tree.nodes.filter("level > 0").select("pid", "key", "level", "index", "node")
    if tree.families is not None:
        asked = asked.select("pid", "key", "level", F.explode(ends).alias("parent"))
        sent = asked.join(tree.families, ["key", "level", "parent"]).select("pid", "key", "level", F.inline("kids"))
        context = context.unionByName(sent)
    told = spans.select("pid", "key", "start", "total")
    if upper is not None:
        told = told.join(upper.select("key", "top", F.col("path").alias("upper")), "key")
    else:
        told = told.withColumn("top", F.lit(None).cast("string")).withColumn("upper", F.lit(None).cast(_PATH))
    rows = told.withColumn("kind", F.lit(0)).unionByName(context.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(tree.rows.select("pid", "key", F.lit(2).alias("kind"), F.col("leaf").alias("node"), "ord", *also), allowMissingColumns=True)
    ordered = rows.repartitionById(max(1, tree.rows.rdd.getNumPartitions()), "pid").sortWithinPartitions("kind", "key", "ord", "node")
    kept = [f for f in tree.rows.schema.fields if f.name in ("ord", *also)]
    schema = T.StructType([*kept, T.StructField("leaf", T.StringType()), T.StructField("top", T.StringType()), T.StructField("path", T._parse_datatype_string(_PATH))])
    names = [f.name for f in kept]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source: dict[str, tuple] = {}
        nodes: dict[tuple[str, int], dict[int, str]] = {}
        key, start, total, rest, above = None, 0, 0, [], {}
        index = 0
        run: list[tuple[int, str, list]] = []
        out: list[tuple] = []
        kinds: list[pa.DataType] = []

        def steps(level: int, at: int) -> list[tuple[str, str]]:
            """From a node up to the root; what stands above a run is found once for all of it."""
            if (level, at // BASE) not in above:
                above[level, at // BASE] = rest if BASE ** (level + 1) >= total else steps(level + 1, at // BASE)
            if BASE**level >= total:
                return rest
            first = at // BASE * BASE
            own = nodes[key, level]
            run = range(first, min(first + BASE, -(-total // BASE**level)))
            return [("".join(own[i] for i in run if i < at), "".join(own[i] for i in run if i > at)), *above[level, at // BASE]]

        def flush() -> None:
            """A run of leaves, whole but for those of other partitions."""
            own = nodes.setdefault((key, 0), {})
            own.update((i, x) for i, x, _ in run)
            out.extend((*values, x, source[key][2], steps(0, i)) for i, x, values in run)
            for i, _, _ in run:
                del own[i]
            run.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            *plain, path = zip(*rows, strict=True)
            offsets = [0]
            for p in path:
                offsets.append(offsets[-1] + len(p))
            both = list(zip(*(s for p in path for s in p), strict=True)) or [(), ()]
            told = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in both], fields=list(_STEP))
            columns = [pa.array(v, t) for v, t in zip(plain, [*kinds, pa.string(), pa.string()], strict=True)]
            return pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), told)], schema.names)

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            kind = batch.column("kind").to_pylist()
            keys, values = batch.column("key").to_pylist(), batch.column("node").to_pylist()
            first_leaf = kind.index(2) if 2 in kind else len(kind)
            told = batch.slice(0, first_leaf).select(["start", "total", "top", "upper", "level", "index"]).to_pylist()
            for i, t in enumerate(told):
                if kind[i]:
                    nodes.setdefault((keys[i], t["level"]), {})[t["index"]] = values[i].hex()
                else:
                    source[keys[i]] = (t["start"], t["total"], t["top"], [(s["before"], s["after"]) for s in t["upper"] or ()])
            also_values = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            for i in range(first_leaf, len(kind)):
                if keys[i] != key:
                    if run:
                        flush()
                    key, above = keys[i], {}
                    start, total, _, rest = source[key]
                    index = start
                run.append((index, values[i].hex(), list(also_values[i])))
                index += 1
                if index % BASE == 0:
                    flush()
                    if len(out) >= PROOFS:
                        yield batch_of(out)
                        out = []
        if run:
            flush()
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(prove, schema)


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", order: str = "doc_id") -> DataFrame:
    """key (of the source: nulls first, then by bytes), ord and leaf of every row, and `changed`: the leaf of a row whose text
    has been tampered with (A-Z in lower case), where 5 divides the crc32 of its doc_id."""
    rows = pick(docs, *dict.fromkeys((*fields, source, order)))
    tampered = [F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in fields]
    chosen = F.crc32(F.col(order).cast("string").cast("binary")) % 5 == 0
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit(""))
    return rows.select(key.alias("key"), F.col(order).alias("ord"), leaf(*map(F.col, fields)).alias("leaf"), F.when(chosen, leaf(*tampered)).alias("changed"))


@dataclass
class Manifest:
    """The trees of the sources, the tree over their roots, and its root (None if there are no rows)."""

    sources: Tree
    over: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """ord, leaf, changed, top (the source's root) and path (up to the root) of every row."""
        above = paths(self.over, None).select(F.col("ord").alias("key"), F.col("leaf").alias("top"), "path")
        return paths_joined(self.sources, above)

    def records(self) -> DataFrame:
        """source, level, index and node of every node above the leaves; those over the sources have `of_sources` true."""
        source = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
        own = self.sources.records().select(source.alias("source"), "level", "index", F.lower(F.hex("node")).alias("node"), F.lit(False).alias("of_sources"))
        return own.unionByName(self.over.records().select(F.lit(None).cast("string").alias("source"), "level", "index", F.lower(F.hex("node")).alias("node"), F.lit(True).alias("of_sources")))


def paths_joined(tree: Tree, above: DataFrame) -> DataFrame:
    """Paths up to the root over all sources: a source's own, then those of its root."""
    return paths(tree, above, "changed")


def manifest(docs: DataFrame) -> Manifest:
    sources = grow(leaves_of(docs))
    over = grow(sources.tops.select(F.lit("").alias("key"), F.col("key").alias("ord"), F.col("node").alias("leaf")))
    top = over.tops.first()
    return Manifest(sources, over, None if top is None else bytes(top["node"]).hex())


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    made = manifest(documents(spark, sf_dir))
    found = made.proofs()
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256)
    own = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    folded = F.aggregate("path", own, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))
    rows = found.select(F.col("ord").alias("doc_id"), "leaf", F.col("top").alias("subroot"), F.lit(made.root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
