"""Language by nearest centroid: TF-IDF vectors of hashed byte n-grams against several centroids of each language.

Fitted on a bounded sample of labelled documents: at most EACH of a language, MOST in all and SAMPLE_CHARS characters. A
text's vector counts its whole text, however long. The language is that of the centroid with the largest cosine, of equal ones
the first in order of names; `rejected` marks texts that lie farther from it than the sample's own texts do. A null text
or one without a letter is `und`, and rejected. Rows that repeat a doc_id are learnt from once, and predicted each for
itself; equal texts get equal results; with nothing to learn from every text is `und`. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, pick, slices
from .sample import choose, texts_of
from .wordmemo import join

DIMENSIONS = 4096
EACH = 400
#: Documents that the sample holds at most; their counts come to the driver.
MOST = 4000
CENTROIDS = 4
#: A text is rejected below this share of the cosine that all but one in 500 of its language's sample reach.
REJECT = 0.5
#: Texts of fewer n-grams are rejected at a smaller cosine.
FULL = 1000
#: Texts, and text bytes, whose vectors are held at a time.
STEP, STEP_BYTES = 64, 256 << 10
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:97] = 32
_FOLD[123:128] = 32


def vectors(texts: list[str]) -> np.ndarray:
    """Counts of each text's hashed 2- and 3-grams of bytes, in lower case, all but letters as blanks."""
    data, at = join([b"  " + t.lower().encode("utf-8", "replace") + b"  " for t in texts])
    b = _FOLD[data].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    out = np.zeros((len(texts), DIMENSIONS), np.int32)
    for grams, short in ((two, 1), (three, 2)):
        slot = (grams * np.uint32(2654435761)) >> np.uint32(20)  # the upper 12 bits
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            for k in range(a, b - short, STEP_BYTES):
                out[i] += np.bincount(slot[k : min(b - short, k + STEP_BYTES)], minlength=DIMENSIONS)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts.astype(np.float32)) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def cluster(points: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the first point and then each time from the one farthest from all starts."""
    centres = points[:1]
    while len(centres) < min(k, len(points)):
        centres = np.concatenate([centres, points[[(points @ centres.T).max(1).argmin()]]])
    for _ in range(steps):
        near = (points @ centres.T).argmax(1)
        centres = np.stack([points[near == i].sum(0) if (near == i).any() else c for i, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


class Languages:
    """The fitted classifier."""

    def __init__(self, counts: np.ndarray, labels: list[str], k: int = CENTROIDS):
        df = (counts > 0).sum(0)
        self.idf = np.log((1 + len(labels)) / (1 + df)).astype(np.float32) + np.float32(0.1)
        points, named = weigh(counts, self.idf), np.array(labels, object)
        self.names, centres, self.floor = [], [], []
        for name in sorted(set(labels)):
            own = points[named == name]
            found = cluster(own, k)
            self.names += [name] * len(found)
            self.floor += [REJECT * float(np.quantile((own @ found.T).max(1), 0.002))] * len(found)
            centres.append(found)
        self.centres = np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        named, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.names else []
        for k in range(0, len(able), STEP):
            part = able[k : k + STEP]
            counts = vectors([texts[i] for i in part])
            close = weigh(counts, self.idf) @ self.centres.T
            best = close.argmax(1)
            # A short text shows few of its language's n-grams: its cosine grows about as the square root of their number.
            ease = np.sqrt(np.minimum(1.0, counts.sum(1) / FULL))
            for i, j, c, e in zip(part, best.tolist(), close[np.arange(len(part)), best].tolist(), ease.tolist(), strict=True):
                named[i], score[i], rejected[i] = self.names[j], min(1.0, max(0.0, round(c, 6))), c < self.floor[j] * e
        return named, score, rejected


def fit(train: DataFrame, each: int = EACH) -> Languages:
    """Learns from text and lang of the rows of train."""
    rows = pick(train, "doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    chosen = choose(rows.select("doc_id", "lang", F.length("text").alias("n")), "lang", each, MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=STEP_BYTES):
            texts = part.column("text").to_pylist()
            for k in range(0, len(texts), STEP):
                packed = [v.astype("<u4").tobytes() for v in vectors(texts[k : k + STEP])]
                yield pa.record_batch([part.column("doc_id")[k : k + STEP], part.column("lang")[k : k + STEP], pa.array(packed, pa.binary())], ["doc_id", "lang", "counts"])

    found = texts_of(rows, chosen, "lang").mapInArrow(run, "doc_id long, lang string, counts binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["counts"])))
    counts = np.stack([np.frombuffer(r["counts"], "<u4") for r in found]) if found else np.zeros((0, DIMENSIONS), np.uint32)
    return Languages(counts, [r["lang"] for r in found])


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score, rejected for the whole text of every row; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=STEP_BYTES):
            named, score, rejected = model.predict(part.column("text").to_pylist())
            yield pa.record_batch([part.column("doc_id"), pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
