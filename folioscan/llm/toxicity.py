"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's chance is logistic in the words it holds; a document's is the noisy-or of its sentences'. Weights are fitted
to document labels alone, by gradient steps on the noisy-or's likelihood, over the words that tell the two labels apart
best in a bounded sample (at most EACH documents of a label and SAMPLE_CHARS characters). `offending` locates sentences.
A null or empty text has no sentence and gets the chance of an empty sentence; equal texts get equal scores, and a very long
text is scored whole. Rows that repeat a doc_id are learnt from once (the least text) and scored each for itself. Of words
that tell the labels apart equally well those of least hash are taken. Without labelled rows of both kinds every text gets
the same score; empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, pick, slices
from .sample import choose, texts_of
from .wordmemo import join, keys

EACH = 2000
#: Words that carry a weight.
WORDS = 300
#: Pull of the weights towards 0, chosen by cross-validation on training rows.
SHRINK = 2e-5
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_KIND = np.zeros(256, np.uint8)  # 1: in a word, 2: ends a sentence
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[ord(c) for c in ".!?\n"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def instances(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its sentence's number within the text, and its text's number."""
    data, at = join([t.encode("utf-8", "replace") + b"\n" for t in texts])
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 1, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = turns[::2], turns[1::2] - turns[::2]
    ends = np.cumsum(kind == 2)
    doc = np.searchsorted(at, start, "right") - 1
    base = np.concatenate([[0], ends])[at[:-1]]
    return keys(_LOWER[data], start, length)[1], ends[start] - base[doc], doc


class Noisy:
    """The fitted model: a bias, and a weight for each hash in ascending order."""

    def __init__(self, bias: float, hashes: np.ndarray, weights: np.ndarray):
        self.bias, self.hashes, self.weights = bias, hashes, weights

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)

    def score(self, texts: list[str]) -> np.ndarray:
        h, sentence, doc = instances(texts)
        out = np.full(len(texts), np.log1p(-_sigmoid(np.array([self.bias])))[0])
        if len(h):
            w = self.weigh(h)
            new = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])])
            first = np.flatnonzero(new)
            z = self.bias + np.add.reduceat(w, first)
            # Sentences without a weighted word are all alike; they share one sentence's chance.
            hit = np.add.reduceat(w != 0, first) > 0
            np.add.at(out, doc[first][hit], np.log1p(-_sigmoid(z[hit])))
        return np.round(-np.expm1(out), 6)

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Start, end and chance of each sentence of at least this chance."""
        out = []
        for m in SENTENCE.finditer(text):
            if m[0].strip() and (p := float(_sigmoid(self.bias + self.weigh(instances([m[0]])[0]).sum()))) >= least:
                out.append((m.start(), m.end(), round(p, 6)))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 13)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, words: int = WORDS, steps: int = 300) -> Noisy:
    """docs: of each document the words' hashes and their sentences' numbers."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Noisy(float(np.log((share + 0.01) / (1.01 - share))), np.zeros(0, np.uint64), np.zeros(0))
    seen = [np.unique(h) for h, _ in docs]
    every, which = np.unique(np.concatenate(seen), return_inverse=True)
    y = np.repeat(labels, [len(x) for x in seen])
    with_1, with_0 = np.bincount(which[y == 1], minlength=len(every)), np.bincount(which[y == 0], minlength=len(every))
    n1, n0 = labels.sum(), (1 - labels).sum()
    a, b = (with_1 + 0.5) / (n1 + 1), (with_0 + 0.5) / (n0 + 1)
    z = np.log(a / b) / np.sqrt(1 / (with_1 + 0.5) + 1 / (with_0 + 0.5))
    z[with_1 + with_0 < 3] = 0
    best = np.sort(np.argsort(-np.abs(z), kind="stable")[:words])
    best = best[np.abs(z[best]) > 3]
    hashes = every[best]
    # Sentences that hold one of these words; a document also has one sentence with none of them.
    rows, columns, doc_of, n = [], [], list(range(len(docs))), len(docs)
    for d, (h, sentence) in enumerate(docs):
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
        pairs = np.unique(np.stack([sentence[hit], at[hit]], 1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
        numbers, local = np.unique(pairs[:, 0], return_inverse=True)
        rows.append(n + local)
        columns.append(pairs[:, 1])
        doc_of += [d] * len(numbers)
        n += len(numbers)
    row, column, doc = np.concatenate(rows), np.concatenate(columns), np.array(doc_of)
    w, bias = np.zeros(len(hashes)), -3.0
    moment, square, y = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1), labels.astype(float)
    for step in range(1, steps + 1):
        p = _sigmoid(bias + np.bincount(row, w[column], minlength=n))
        quiet = np.bincount(doc, np.log1p(-p), minlength=len(docs))
        chance = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
        pull = (p * np.where(y == 1, -(1 - chance) / chance, 1.0)[doc]) / len(docs)
        grad = np.append(np.bincount(column, pull[row], minlength=len(w)) + SHRINK * w, pull.sum())
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Noisy(float(bias), hashes, w)


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Noisy:
    """Learns from the texts of docs and the labels (doc_id, toxic); a document with several labels counts as toxic if one says so."""
    marked = pick(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = pick(docs, "doc_id", "text").filter("text IS NOT NULL")
    sized = rows.select("doc_id", F.length("text").alias("n")).join(marked, "doc_id")
    chosen = choose(sized, "toxic", each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            h, sentence, doc = instances(part.column("text").to_pylist())
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            packed = [[x[a:b].astype(t).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x, t in ((h, "<u8"), (sentence, "<i4"))]
            yield pa.record_batch([part.column("doc_id"), part.column("toxic"), *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "toxic", "h", "s"])

    kind = dict(chosen.dtypes)["toxic"]
    found = texts_of(rows, chosen, "toxic").mapInArrow(run, f"doc_id long, toxic {kind}, h binary, s binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["h"])))
    return train([(np.frombuffer(r["h"], "<u8"), np.frombuffer(r["s"], "<i4")) for r in found], np.array([int(r["toxic"] > 0) for r in found], np.int64))


def score(docs: DataFrame, model: Noisy) -> DataFrame:
    """doc_id and score of the whole text of every row; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = model.score([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def locate(docs: DataFrame, model: Noisy, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, chance of every offending sentence, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(d, *x) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for x in model.offending(t or "", least)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "start", "end", "chance"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, chance double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.filter(crc_mod("doc_id", 5) != 0), labels.filter(crc_mod("doc_id", 5) != 0))
    out = score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
