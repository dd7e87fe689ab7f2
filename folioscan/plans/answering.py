"""Answers to questions on documents of pages, from retrieval to the choice of an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.operators import chunking as C
from folioscan.operators import models as M
from folioscan.operators import ranking as R

MODES = ("oracle", "concat", "maxconf", "anyconf", "maxconfpage", "anyconfpage", "anyconforacle", "majorpage", "weightmajorpage", "custom", "none", "whole")

#: Pages of a document, and chunks of a page, whose vectors a task holds together; similarities and results that it holds at a time.
PAGES, CHUNKS, CELLS, ROWS = 64, 256, 1_000_000, 2_000
#: What retrieval tells of a question and of a chunk.
_KEPT = (["question_id", "question"], ["doc_id", "page_idx", "chunk_id", "words"])


@dataclass(frozen=True)
class Rerank:
    """Retrieved chunks are scored anew with their question; those at or above threshold stay, `most` at the most, `least` at the least."""

    scorer: Callable[[], M.PairScorer] = M.SharedWords
    threshold: float = 0.4
    most: int = 5
    least: int = 1


def retrieve(questions: DataFrame, pages: DataFrame, k: int, rule: C.ChunkRule, embedder: Callable[[], M.Embedder], gold: bool = False) -> DataFrame:
    """question_id, question, doc_id, page_idx, chunk_id, words, sim, rank: the k best chunks with words of each question's document.

    With gold, only chunks of the question's own gold_page are candidates. Vectors meet as matrices: the chunks of some pages of
    a document stand still, and its questions pass by them.
    """
    text = F.array_join("words", " ")
    chunks = C.chunks(pages.select("doc_id", "page_idx", "words"), rule).filter(F.size("words") > 0)
    chunks = chunks.select("doc_id", "page_idx", "chunk_id", "words", F.floor(F.col("page_idx") / PAGES).alias("some"), F.floor(F.col("chunk_id") / CHUNKS).alias("part"), M.embedding(text, embedder).alias("vector"))
    of = [*(["doc_id", "page_idx"] if gold else ["doc_id"]), "some", "part"]
    page = [F.col("gold_page").alias("page_idx")] if gold else []
    asked = questions.select("question_id", "doc_id", *page, "question", M.embedding(F.col("question"), embedder).alias("vector"))
    asked = asked.join(chunks.select(*of).distinct(), of[:-2]).withColumn("asks", F.lit(1))
    rows = chunks.withColumn("asks", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    group = Window.partitionBy(*of).orderBy("asks")
    rows = rows.withColumn("first", F.row_number().over(group) == 1).select("first", "asks", "question_id", "question", "doc_id", "page_idx", "chunk_id", "words", "vector")
    out = T.StructType([rows.schema[c] for c in _KEPT[0] + _KEPT[1]] + [T.StructField("sim", T.DoubleType())])
    found = rows.mapInArrow(_best_chunks(k), out)
    return R.top_k(found, ["question_id"], "sim", ["page_idx", "chunk_id"], k)


def _best_chunks(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best chunks of each question in each group of rows: its chunks come first and are held, its questions pass by."""

    def scored(block: pa.Table, vectors: np.ndarray, norms: np.ndarray, asking: pa.RecordBatch) -> pa.Table:
        q = _matrix(asking.column("vector"))
        near = q @ vectors.T / (np.sqrt((q**2).sum(1))[:, None] * norms + 1e-8)
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]  # chunks stand in the order of ties
        at = pa.array(np.repeat(np.arange(len(q)), best.shape[1]))
        told = [asking.column(c).take(at) for c in _KEPT[0]] + [block.column(c).take(pa.array(best.ravel())) for c in _KEPT[1]]
        return pa.table([*told, pa.array(np.take_along_axis(near, best, 1).ravel())], [*_KEPT[0], *_KEPT[1], "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, out = [], None, []
        for batch in batches:
            first, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "asks"))
            cuts = np.flatnonzero(first | (np.diff(asks, prepend=asks[:1]) != 0))
            cuts = [0, *cuts[cuts > 0].tolist(), len(asks)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if first[s]:
                    held, block = [], None
                if not asks[s]:
                    held.append(batch.slice(s, e - s))
                    continue
                if not held:
                    continue
                if block is None:
                    block = pa.Table.from_batches(held).sort_by([("page_idx", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
                    vectors = _matrix(block.column("vector").combine_chunks())
                    norms = np.sqrt((vectors**2).sum(1))
                step = max(1, CELLS // len(vectors))
                for at in range(s, e, step):
                    out.append(scored(block, vectors, norms, batch.slice(at, min(step, e - at))))
                    if sum(map(len, out)) >= ROWS:
                        yield from pa.concat_tables(out).combine_chunks().to_batches()
                        out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def reranked(best: DataFrame, how: Rerank) -> DataFrame:
    """The rows of `retrieve` that a second scorer keeps, ranked by its scores."""
    scored = best.withColumn("score", M.pair_score(F.col("question"), F.array_join("words", " "), how.scorer))
    kept = R.rerank(scored, ["question_id"], "score", ["rank"], how.threshold, how.most, how.least)
    return kept.withColumn("rank", F.col("new_rank")).drop("score", "new_rank", "n_pass")


def with_surroundings(best: DataFrame, pages: DataFrame, rule: C.ChunkRule, around: int) -> DataFrame:
    """The rows of `retrieve` with up to `around` words more on either side, from the list of the page's chunk words.

    A word that a better chunk of the question has taken isn't taken again; a chunk of which nothing is left stays, empty.
    """
    chunks = C.chunks(pages.select("doc_id", "page_idx", "words"), rule).withColumn("n", F.size("words"))
    before = Window.partitionBy("doc_id", "page_idx").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    places = chunks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).select("doc_id", "page_idx", "chunk_id", "first", "n")
    lists = chunks.groupBy("doc_id", "page_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "words"))), lambda c: c["words"])).alias("every"))
    kept = best.join(places, ["doc_id", "page_idx", "chunk_id"]).join(lists, ["doc_id", "page_idx"])
    grown = F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - around), F.least(F.size("every") - 1, F.col("first") + F.col("n") - 1 + around)))
    words = kept.select("question_id", "doc_id", "page_idx", "rank", "every", grown.alias("pos")).select("question_id", "doc_id", "page_idx", "rank", "pos", F.get("every", F.col("pos")).alias("word"))
    taken = words.groupBy("question_id", "doc_id", "page_idx", "pos").agg(F.min("rank").alias("rank"), F.first("word").alias("word"))
    again = taken.groupBy("question_id", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]).alias("grown"))
    held = best.drop("words").join(again, ["question_id", "rank"], "left")
    return held.withColumn("words", F.coalesce("grown", F.array().cast("array<string>"))).drop("grown")


def windows(questions: DataFrame, pages: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """question_id, question, doc_id, page_idx, words: at most `most` pages in a row of each question's document, its gold page among them."""
    n = pages.groupBy("doc_id").agg(F.max("page_idx").alias("last"))
    low = F.greatest(F.lit(0), F.col("gold_page") - most + 1)
    high = F.least(F.col("gold_page"), F.greatest(F.lit(0), F.col("last") + 1 - most))
    first = low + F.pmod(F.xxhash64(F.lit(seed), "question_id"), F.greatest(F.lit(1), high - low + 1))
    cut = questions.join(n, "doc_id").withColumn("first", first)
    return cut.join(pages, "doc_id").filter((F.col("page_idx") >= F.col("first")) & (F.col("page_idx") < F.col("first") + most)).select("question_id", "question", "doc_id", "page_idx", "words")


def answer_questions(questions: DataFrame, pages: DataFrame, mode: str = "concat", k: int = 10, rule: C.ChunkRule = C.ChunkRule(), embedder: Callable[[], M.Embedder] = M.HashedTerms, answerer: Callable[[], M.Answerer] = M.BestSentence, rerank: Rerank | None = None, around: int = 0, max_pages: int = 1) -> DataFrame:
    """question_id, answers (array of answer, confidence) and pages (those of its evidence, best first) of every question.

    questions: question_id, doc_id, question, and gold_page for the oracle modes and custom; pages: doc_id, page_idx, words.
    Only the any modes give more than one answer, one for each chunk or page, best first; a question without evidence gets none.
    Page modes take each of the retrieved pages once. Without retrieval, custom reads a window of max_pages pages around the
    gold page, none the first page (of documents that have but one), and whole the whole document. Retrieved chunks may be
    reranked, and grown by `around` words. But for whole, nothing but k rows of a question is collected in one place.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    whole = pages.select("doc_id", "page_idx", F.array_join("words", " ").alias("context"))
    if mode == "oracle":
        own = questions.withColumnRenamed("gold_page", "page_idx").join(whole, ["doc_id", "page_idx"])
        contexts = own.select("question_id", "question", F.lit(1).alias("rank"), "page_idx", "context")
        listed = contexts.select("question_id", F.array("page_idx").alias("pages"))
    elif mode in ("custom", "none", "whole"):
        if mode == "custom":
            read = windows(questions, pages, max_pages)
        else:
            read = questions.select("question_id", "question", "doc_id").join(pages.select("doc_id", "page_idx", "words"), "doc_id")
            read = read.join(pages.groupBy("doc_id").agg(F.min("page_idx").alias("page_idx")), ["doc_id", "page_idx"], "left_semi") if mode == "none" else read
        held = read.groupBy("question_id", "question").agg(F.array_sort(F.collect_list(F.struct("page_idx", "words"))).alias("p"))
        context = F.array_join(F.flatten(F.transform("p", lambda x: x["words"])), " ")
        contexts = held.select("question_id", "question", F.lit(1).alias("rank"), context.alias("context"))
        listed = held.select("question_id", F.col("p.page_idx").alias("pages"))
    else:
        best = retrieve(questions, pages, k, rule, embedder, mode == "anyconforacle")
        best = reranked(best, rerank) if rerank else best
        best = with_surroundings(best, pages, rule, around) if around else best
        listed = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_idx"))).alias("p")).select("question_id", F.array_distinct("p.page_idx").alias("pages"))
        if mode == "concat":
            joined = C.concat_evidence(best, ["question_id"], "rank")
            contexts = joined.join(questions.select("question_id", "question"), "question_id").withColumn("rank", F.lit(1))
        elif mode in ("maxconfpage", "anyconfpage"):
            once = best.groupBy("question_id", "question", "doc_id", "page_idx").agg(F.min("rank").alias("rank"))
            contexts = once.join(whole, ["doc_id", "page_idx"])
        elif mode in ("majorpage", "weightmajorpage"):
            weight = F.lit(1) if mode == "majorpage" else F.col("sim")
            voted = R.page_vote(best, ["question_id", "doc_id", "question"], "page_idx", weight).drop("votes")
            contexts = voted.join(whole, ["doc_id", "page_idx"]).withColumn("rank", F.lit(1))
            listed = voted.select("question_id", F.array("page_idx").alias("pages"))
        else:
            contexts = best.withColumn("context", F.array_join("words", " "))
    given = contexts.select("question_id", F.col("rank").alias("place"), M.answer(F.col("question"), F.col("context"), answerer).alias("a"))
    if mode.startswith("maxconf"):
        given = R.best(given.withColumn("confidence", F.col("a.confidence")), ["question_id"], "confidence", ["place"])
    row = F.struct("place", F.col("a.answer").alias("answer"), F.col("a.confidence").alias("confidence"))
    answers = given.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    kept = answers.select("question_id", F.transform("r", lambda x: F.struct(x["answer"].alias("answer"), x["confidence"].alias("confidence"))).alias("answers"))
    empty = F.array().cast("array<struct<answer:string,confidence:double>>")
    out = questions.select("question_id").join(kept, "question_id", "left").join(listed, "question_id", "left")
    return out.select("question_id", F.coalesce("answers", empty).alias("answers"), F.coalesce("pages", F.array().cast(dict(pages.dtypes)["page_idx"].join(("array<", ">")))).alias("pages"))
