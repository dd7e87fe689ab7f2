"""Samples that a rule fixes: the same rows whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotas(sizes: dict[int, int], n: int) -> dict[int, int]:
    """Equal shares of n for every stratum, what is left over to the smallest strata keys, shortfalls dealt on in turn."""
    keys = sorted(sizes)
    out = {k: min(sizes[k], n // len(keys) + (i < n % len(keys))) for i, k in enumerate(keys)} if keys else {}
    while sum(out.values()) < min(n, sum(sizes.values())):
        for k in keys:
            if out[k] < sizes[k] and sum(out.values()) < n:
                out[k] += 1
    return out


def stratified(rows: DataFrame, stratum: str, n: int, order: list[Column]) -> DataFrame:
    """n rows, as evenly over the strata as their sizes allow. The strata are counted on the driver: page counts, a few."""
    sizes = {r[stratum]: r["count"] for r in rows.groupBy(stratum).count().collect()}
    share = quotas(sizes, n)
    quota = F.create_map(*(F.lit(x) for kv in share.items() for x in kv)) if share else F.create_map().cast("map<long,int>")
    # The bound by a number lets Spark keep a few rows of each stratum before they are exchanged.
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("rank") <= max(share.values(), default=0))
    return ranked.filter(F.col("rank") <= F.coalesce(F.try_element_at(quota, F.col(stratum)), F.lit(0))).drop("rank")


def mix_pages(original: DataFrame, noise: DataFrame, place: Column) -> DataFrame:
    """Original pages in their order with noise pages put before the original page at `place`; pages are numbered anew.

    Both have doc_id, page_idx; `place` is computed from noise's columns. was_noise and old_page say where a page came from.
    """
    a = original.select("doc_id", F.col("page_idx").alias("at"), F.lit(1).alias("own"), F.lit(0).alias("k"), F.col("page_idx").alias("old_page"))
    b = noise.select("doc_id", place.alias("at"), F.lit(0).alias("own"), F.col("k"), F.col("page_idx").alias("old_page"))
    order = Window.partitionBy("doc_id").orderBy("at", "own", "k", "old_page")
    both = a.unionByName(b).withColumn("page_idx", F.row_number().over(order) - 1)
    return both.select("doc_id", "page_idx", "old_page", (F.col("own") == 0).alias("was_noise"))


def group_rank(rows: DataFrame, by: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """The rows with `rank` from 1 in each group, ordered by bucket, then `order`; no task sorts a whole group.

    bucket is a coarse whole number that the order follows, so that a bucket of a group has few rows. Rows are ranked in their
    buckets, and the counts of the earlier buckets added; a window over the counts alone sees one row for each bucket.
    """
    marked = rows.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = marked.withColumn("_within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).alias("l")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = within.join(counts.alias("r"), same).withColumn("rank", F.col("_before") + F.col("_within"))
    return joined.select(*(F.col(f"l.{c}") for c in rows.columns), "rank")


def held_out(pool: DataFrame, seeds: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows, in a fixed order, of the pool's rows whose key isn't among the seeds."""
    return pool.join(seeds.select(key), key, "left_anti").orderBy(*order).limit(n)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the comparison reaches the files' statistics."""
    return rows.filter(F.col(key) == F.lit(value))


def subset(ranked: DataFrame, size: float | tuple[int, int], total: int) -> DataFrame:
    """Rows of a head part (a fraction of total) or of a range of places, by a rank from 1."""
    first, last = (0, int(size * total)) if isinstance(size, float) else size
    return ranked.filter((F.col("rank") > first) & (F.col("rank") <= last))


def shard(ranked: DataFrame, part: int, parts: int) -> DataFrame:
    """Every parts-th row from `part` on, by a rank from 1."""
    return ranked.filter((F.col("rank") - 1) % parts == part)


def strides(n: int, most: int = 16) -> list[int]:
    """Up to `most` steps below 200 that go round all of n places before they come back."""
    return [x for x in range(1, 200) if math.gcd(x, n) == 1][:most]


def noise_draws(docs: DataFrame, n_docs: int, k: int, seed: int = 0) -> DataFrame:
    """doc_id, k, other, page_idx: k pages of other documents for each document, from 0 to k - 1.

    docs: doc_id, at (numbered from 0), n_pages. The others are taken in an order of the document's own: from a place and by a
    step that its number and the seed say, round all other documents, so none comes twice before each has come. No pairs of
    documents are made but those drawn. With one document there are none, and a document without pages gives none.
    """
    if n_docs < 2:
        return docs.select("doc_id", F.lit(0).cast("long").alias("k"), F.col("doc_id").alias("other"), F.col("n_pages").alias("page_idx")).limit(0)
    by = F.array(*map(F.lit, strides(n_docs - 1)))
    drawn = docs.select("doc_id", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("k"))
    step = F.get(by, F.pmod(F.col("at") + seed, F.size(by)).cast("int"))
    place = F.pmod(F.col("at") * 31 + seed * 17 + F.col("k") * step, F.lit(n_docs - 1))
    drawn = drawn.withColumn("to", (F.col("at") + 1 + place) % n_docs)
    held = docs.filter("n_pages > 0").select(F.col("at").alias("to"), F.col("doc_id").alias("other"), "n_pages")
    page = F.pmod(F.col("at") * 5 + F.col("to") * 3 + F.col("k") * 7 + seed, F.col("n_pages"))
    return drawn.join(held, "to").select("doc_id", "k", "other", page.cast("long").alias("page_idx"))


def other_entries(entries: DataFrame, draws: DataFrame, n_docs: int) -> DataFrame:
    """The columns of draws, other, entry, page_idx: a page of another document for each draw; all three are drawn independently.

    entries: doc (numbered from 0), entry, at (numbered from 0 in its document), n_entries, n_pages. draws: doc and the numbers
    r_doc, r_entry, r_page, of any size. A draw that comes upon an entry without pages gives none, and with one document none does.
    """
    far = (F.col("doc") + 1 + F.pmod("r_doc", F.lit(max(1, n_docs - 1)))) % n_docs
    sizes = entries.groupBy("doc").agg(F.max("n_entries").alias("n_entries")).withColumnRenamed("doc", "other")
    drawn = draws.filter(F.lit(n_docs > 1)).withColumn("other", far).join(sizes, "other").withColumn("at", F.pmod("r_entry", F.col("n_entries")))
    held = entries.select(F.col("doc").alias("other"), "entry", "at", "n_pages")
    found = drawn.join(held, ["other", "at"]).filter("n_pages > 0")
    return found.select(*draws.columns, "other", "entry", F.pmod("r_page", F.col("n_pages")).alias("page_idx"))
