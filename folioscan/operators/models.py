"""Plug-ins for models: what an embedder, a pair scorer and an answerer must offer, and lexical ones that need no weights.

A maker (a function without arguments that can be pickled) is called once in each task, so that weights are loaded there and
not sent from the driver. Scores made with the lexical plug-ins say nothing about those of a neural model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.masks import regions

WORD = re.compile(r"\w+")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """How well each second text answers the first."""


class Answerer(Protocol):
    def answer(self, questions: list[str], contexts: list[str]) -> list[tuple[str, float]]:
        """An answer and its confidence (0 to 1) for each question and its context."""


class HashedTerms:
    """Term counts of lower-cased words, hashed to a fixed number of slots."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for w in WORD.findall(text.lower()):
                row[zlib.crc32(w.encode()) % self.size] += 1
        return out


class SharedWords:
    """The share of the first text's distinct words that the second one holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            asked = set(WORD.findall(a.lower()))
            out.append(len(asked & set(WORD.findall(b.lower()))) / len(asked) if asked else 0.0)
        return out


class BestSentence:
    """The first of the sentences that share most words with the question; the share is the confidence."""

    def answer(self, questions: list[str], contexts: list[str]) -> list[tuple[str, float]]:
        out, last, asked = [], None, set()
        for q, c in zip(questions, contexts, strict=True):
            if q != last:
                last, asked = q, set(WORD.findall(q.lower()))
            parts = [p.strip() for p in re.split(r"(?<=[.!?])\s", c) if p.strip()] or [""]
            scores = [len(asked.intersection(WORD.findall(p.lower()))) / len(asked) if asked else 0.0 for p in parts]
            best = max(range(len(parts)), key=scores.__getitem__)
            out.append((parts[best], scores[best]))
        return out


def _texts(column: pd.Series) -> list[str]:
    return column.fillna("").tolist()


def embedding(text: Column, make: Callable[[], Embedder] = HashedTerms) -> Column:
    """The vector of each text; null texts count as empty."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(model.embed(_texts(texts)), float)))

    return run(text)


def pair_score(first: Column, second: Column, make: Callable[[], PairScorer] = SharedWords) -> Column:
    """The score of each pair; null texts count as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in batches:
            yield pd.Series(model.score(list(zip(_texts(a), _texts(b), strict=True))), dtype="float64")

    return run(first, second)


def answer(question: Column, context: Column, make: Callable[[], Answerer] = BestSentence) -> Column:
    """answer and confidence of each question in its context; null texts count as empty."""

    @F.pandas_udf("answer string, confidence double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for q, c in batches:
            yield pd.DataFrame(model.answer(_texts(q), _texts(c)), columns=["answer", "confidence"])

    return run(question, context)


class ImageEncoder(Protocol):
    def encode(self, images: list[bytes]) -> list[np.ndarray]:
        """Vectors, a row for each patch, of each image."""


class LayoutModel(Protocol):
    def detect(self, images: list[bytes]) -> list[tuple[list[tuple[float, float, float, float]], list[int]]]:
        """Boxes, as shares of the page, and labels of each image."""


class SeeingAnswerer(Protocol):
    def answer(self, questions: list[str], contexts: list[str], images: list[list[bytes]]) -> list[tuple[str, float]]:
        """An answer and its confidence for each question, its context and its images."""


class ByteStripes:
    """A stand-in for an image encoder: the shares of byte values in each of four stripes of a file."""

    def encode(self, images: list[bytes]) -> list[np.ndarray]:
        out = []
        for image in images:
            stripes = np.array_split(np.frombuffer(image, np.uint8), 4)
            out.append(np.stack([np.bincount(x >> 5, minlength=8) / max(1, len(x)) for x in stripes]))
        return out


class WholePage:
    """A stand-in for a layout model: one box of text, the whole page."""

    def detect(self, images: list[bytes]) -> list[tuple[list[tuple[float, float, float, float]], list[int]]]:
        return [([(0.0, 0.0, 1.0, 1.0)], [1]) for _ in images]


class ReadingOnly:
    """Answers from the context alone, whatever the images show."""

    def answer(self, questions: list[str], contexts: list[str], images: list[list[bytes]]) -> list[tuple[str, float]]:
        return BestSentence().answer(questions, contexts)


def image_vectors(image: Column, make: Callable[[], ImageEncoder] = ByteStripes) -> Column:
    """The patch vectors of each image; null images have none."""

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for images in batches:
            known = [bytes(x) for x in images if x is not None]
            found = iter(model.encode(known))
            yield pd.Series([[] if x is None else [list(map(float, v)) for v in next(found)] for x in images])

    return run(image)


def layout(image: Column, make: Callable[[], LayoutModel] = WholePage) -> Column:
    """boxes and labels of each image; null images have none."""

    @F.pandas_udf("boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, labels array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for images in batches:
            found = iter(model.detect([bytes(x) for x in images if x is not None]))
            rows = [([], []) if x is None else next(found) for x in images]
            boxes = [[dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True)) for b in row[0]] for row in rows]
            yield pd.DataFrame({"boxes": boxes, "labels": [list(map(int, row[1])) for row in rows]})

    return run(image)


def seen_answer(question: Column, context: Column, images: Column, make: Callable[[], SeeingAnswerer] = ReadingOnly) -> Column:
    """answer and confidence of each question in its context and its array of images."""

    @F.pandas_udf("answer string, confidence double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for q, c, i in batches:
            held = [[] if x is None else [bytes(y) for y in x if y is not None] for x in i]
            yield pd.DataFrame(model.answer(_texts(q), _texts(c), held), columns=["answer", "confidence"])

    return run(question, context, images)


def extracted(question: Column, output: Column, make: Callable[[], Callable[[str, str], str]] | None = None) -> Column:
    """The short answer that a plug-in finds in a model's output; the output itself without a plug-in, or where it fails."""
    if make is None:
        return output

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = make()

        def one(q: str, o: str) -> str:
            try:
                return find(q, o)
            except Exception:  # a plug-in's failure leaves the output as it is
                return o

        for q, o in batches:
            yield pd.Series([one(a, b) for a, b in zip(_texts(q), _texts(o), strict=True)])

    return run(question, output)


def mask_boxes(mask: np.ndarray, least: int = 4) -> list[tuple[int, int, int, int]]:
    """x0, y0, x1, y1 around each region of touching true pixels (corners touch too) of at least `least` pixels, from the top."""
    return [tuple(r[:4]) for r in regions(mask, least).tolist()]


def fit_unanswerable(rows: DataFrame, hidden: int = 16, seed: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Learns from question_vector, context_vector (pooled) and label (1: no answer); gives a function that adds `chance`.

    The two vectors are joined end to end and read by a perceptron with one hidden layer.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def joined(df: DataFrame) -> DataFrame:
        return df.withColumn("_both", array_to_vector(F.concat("question_vector", "context_vector").cast("array<double>")))

    size = rows.select(F.size(F.concat("question_vector", "context_vector")).alias("n")).first()["n"]
    model = MultilayerPerceptronClassifier(featuresCol="_both", labelCol="label", layers=[size, hidden, 2], seed=seed, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(joined(rows))
    return lambda df: model.transform(joined(df)).withColumn("chance", vector_to_array("_p")[1]).drop("_both", "_p", "_r", "_c")
