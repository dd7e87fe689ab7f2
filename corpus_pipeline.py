"""A corpus pipeline: language filter, near-duplicate removal, masking of personal data, mixing, and token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe, language, mixing, pii, simhash
from folioscan.llm.common import crc_mod, cut, map_rows, remove, shared_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that lie too far from every language, and those without a letter; lang becomes the predicted one.

    So null and empty texts go. Very long texts are judged whole, equal texts alike, repeated rows each for itself; an empty
    table stays empty; columns with other or clashing names stay as they are.
    """
    model = language.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        import pyarrow as pa

        from folioscan.llm.common import slices

        for part in slices(batches, f"c{text}", language.STEP_BYTES):
            named, _, rejected = model.predict(part.column(text).to_pylist())
            out = part.set_column(lang, part.schema.field(lang), pa.array(named, part.schema.field(lang).type))
            yield out.filter(pa.array([not r for r in rejected]))

    return map_rows(docs, run)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates: that of least doc_id, of equal ones that of least hash.

    Rows are told apart by a hash of all their columns, so rows of one doc_id with other texts are documents of their own,
    and of rows that are equal in all columns one stays. A row without a doc_id comes after all others, by its text's hash.
    Null and empty texts are one group. An empty table stays empty; columns with other or clashing names stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), {n: f"c{i}" for i, n in reversed(list(enumerate(docs.columns)))}
    last = F.xxhash64(at["text"]).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = plain.withColumns({"id_": F.coalesce(F.col(at["doc_id"]), last), "tie_": F.xxhash64(*names)})
    found = cut(simhash.near_duplicates(rows.select(F.col("id_").alias("doc_id"), F.col(at["text"]).alias("text"), F.col("tie_").alias("tie")), "tie"))
    first = found.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("tie").alias("tie"))
    kept = rows.join(first.select(F.col("doc_id").alias("id_"), F.col("tie").alias("tie_")), ["id_", "tie_"], "left_semi")
    if found.groupBy("doc_id", "tie").count().filter("count > 1").limit(1).count():
        kept = kept.groupBy("id_", "tie_").agg(*(F.first(c).alias(c) for c in names))
    return kept.select(*names).toDF(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars is counted anew.

    Every row stays, null and empty texts as they are (n_chars of a null is null); equal texts are masked alike.
    """
    masked, at = pii.redact(docs), {n: i for i, n in enumerate(docs.columns)}
    plain = masked.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.withColumn(f"c{at['n_chars']}", F.length(f"c{at['text']}").cast("long")).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's texts: a row for each document and pass with the words that the mix takes.

    A document has two rows at most. One without words, so one with a null or empty text, has none; a null source is a source
    like any other; rows that repeat a doc_id are mixed each for itself. An empty table stays empty.
    """
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, and text_sha256 of the bytes that the ids decode to; null texts have no ids."""
    rows = bpe.encode_documents(docs, decode=True)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The language, near-duplicate and tokenizer stages are beyond SQL; tests hold each stage's rows against brute force or a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again, and go once the next has read them."""
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
