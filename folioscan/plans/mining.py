"""Pairs to train a retriever on: questions and those of their retrieved chunks from which they are answered right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import chunking as C
from folioscan.operators import models as M
from folioscan.plans.answering import retrieve


def mined_pairs(questions: DataFrame, pages: DataFrame, k: int = 10, least: float = 0.8, rule: C.ChunkRule = C.ChunkRule(), embedder: Callable[[], M.Embedder] = M.HashedTerms, answerer: Callable[[], M.Answerer] = M.BestSentence) -> DataFrame:
    """question_id, page_idx, chunk_id, anchor (the question), positive (the chunk's text), score.

    Each of a question's k best chunks is read by itself; it is a positive if the answer scores above `least` against one of the
    question's golds, without regard to letter case. questions: question_id, doc_id, question, golds; pages: doc_id, page_idx, words.
    """
    best = retrieve(questions.select("question_id", "doc_id", "question"), pages, k, rule, embedder)
    read = best.select("question_id", "page_idx", "chunk_id", F.col("question").alias("anchor"), F.array_join("words", " ").alias("positive"))
    given = read.withColumn("pred", F.lower(M.answer(F.col("anchor"), F.col("positive"), answerer)["answer"]))
    told = given.join(questions.select("question_id", F.transform("golds", F.lower).alias("golds")), "question_id")
    score = F.array_max(F.transform("golds", lambda g: X.anls_strict(g, F.col("pred"), least)))
    return told.select("question_id", "page_idx", "chunk_id", "anchor", "positive", score.alias("score")).filter(F.col("score") > least)
