"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that a sample holds at most (if no row fits, it holds the shortest).
SAMPLE_CHARS = 24_000_000
#: Rows of more than this share of a label's characters come after all others.
LONG_SHARE = 0.01


def choose(labelled: DataFrame, label: str, each: int, most: int = 20_000, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id and label, distinct, of at most `each` documents of every label value, those of least hash of doc_id.

    labelled has doc_id, the label and n (characters of the text); rows that repeat a doc_id and label count once. With many
    label values fewer documents of each are taken, so that at most `most` come out; of more than `most` values the most
    frequent ones count. Every label first fills an equal part of `chars`; what is left over goes round. A document that
    doesn't fit is passed over, and documents of more than LONG_SHARE of a part come last, lest a few of them fill it.
    """
    spark, kind = labelled.sparkSession, dict(labelled.dtypes)[label]
    known = labelled.dropna(subset=["doc_id", label])
    counts = known.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("count"))
    sizes = counts.orderBy(F.desc("count"), label).limit(most).collect()
    each = max(1, min(each, most // max(1, len(sizes))))
    # Documents above a hash that about twice `each` of their label stay below never leave the executors.
    shares = spark.createDataFrame([(r[label], min(1.0, (2 * each + 8) / r["count"])) for r in sizes], f"{label} {kind}, share double")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = known.withColumn("spread", spread).join(F.broadcast(shares), label).filter("spread <= share")
    found = near.groupBy("doc_id", label, "spread").agg(F.max(F.coalesce("n", F.lit(0))).alias("n")).collect()
    by_label: dict = {}
    for r in sorted(found, key=lambda r: (r["spread"], r["doc_id"])):
        by_label.setdefault(r[label], []).append(r)
    part = chars / max(1, len(by_label))
    rows, rest, left = [], [], float(chars)
    for own in by_label.values():
        held = 0
        for r in sorted(own[:each], key=lambda r: r["n"] > part * LONG_SHARE):
            if held + r["n"] <= part:
                held += r["n"]
                rows.append(r)
            else:
                rest.append(r)
        left -= held
    for r in sorted(rest, key=lambda r: (r["n"], r["spread"], r["doc_id"])):
        if r["n"] <= left:
            left -= r["n"]
            rows.append(r)
    if found and not rows:
        rows.append(min(found, key=lambda r: (r["n"], r["spread"], r["doc_id"])))
    return spark.createDataFrame([(r["doc_id"], r[label]) for r in rows], f"doc_id long, {label} {kind}")


def texts_of(rows: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """doc_id, the label and text of the chosen documents, each once: of rows that share a doc_id the least text counts.

    rows: doc_id and text. chosen is bounded by `choose`, so it is broadcast.
    """
    on = ["doc_id", *([label] if label in rows.columns else [])]
    return rows.join(F.broadcast(chosen), on).groupBy("doc_id", label).agg(F.min("text").alias("text"))
