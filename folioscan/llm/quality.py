"""Quality by weak supervision: rules vote good or bad or abstain, and expectation-maximisation weighs the rules.

Counts come from one pass over the texts. The label model then needs only how often each pattern of votes occurs: at most
3 ** rules patterns, however many rows there are. A rule's accuracy is how often it casts each
vote among good and among bad rows; the posterior chance that a row is good decides, instead of a demand that every rule
passes. Only a prior worth PRIOR rows says what the votes mean; all else is estimated.
A null or empty text has no words, so it fails the base rule; a very long one is counted whole; equal texts get equal
verdicts. A chance of exactly one half is kept. Rows that repeat count and are judged each for itself; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, pick, slices
from .wordmemo import _BLANK, texts_as_bytes, word_ids, words

#: Rows that the prior counts for, and the chances that it starts from of each vote among bad (0) and good (1) rows: a bad row
#: breaks a rule or two and keeps the others.
PRIOR = 50.0
START = {("-", 0): 0.2, ("0", 0): 0.1, ("+", 0): 0.7, ("-", 1): 0.01, ("0", 1): 0.19, ("+", 1): 0.8}
GOOD = 0.9
#: Names of the counts, in the order of the columns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_short")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True  # the first byte of what is beyond ASCII counts as a letter
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80


def text_counts(texts: list[str], window: int = 5) -> dict[str, np.ndarray]:
    """COUNTS of each text. n_repeat_words: words inside `window`-word sequences that stand in the text twice or more."""
    data, at = texts_as_bytes(texts)
    start, length = words(data)
    cuts = np.searchsorted(start, at)
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), at[:-1])
    out = {"n_words": np.diff(cuts), "word_chars": total(_FIRST[data] & ~_BLANK[data]), "n_symbols": total(_SYMBOL[data]), "n_letters": total(_LETTER[data]), "n_upper": total(_UPPER[data])}
    lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    out["n_short"] = np.bincount(doc[(length <= 3) & _LETTER[data[start]]], minlength=len(texts)).astype(np.int64)
    ids = word_ids(data, start, length).astype(np.int64)
    repeated = np.zeros(len(ids), bool)
    if len(ids) >= window:
        # Numbers for ever longer sequences, each made of a shorter one's number and the next word's, so they are exact.
        many, code = int(ids.max()) + 1, ids
        for k in range(1, window):
            code = np.unique(code[: len(ids) - k] * many + ids[k:], return_inverse=True)[1]
        inside = doc[: len(code)] == doc[window - 1 :]
        code = np.where(inside, doc[: len(code)] * (int(code.max()) + 1) + code, -1)
        _, which, count = np.unique(code, return_inverse=True, return_counts=True)
        twice = inside & (count[which] > 1)
        for k in range(window):
            repeated[k : k + len(twice)] |= twice
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=len(texts)).astype(np.int64)
    return out


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = text_counts([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule when it votes bad and when it votes good; else it abstains."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    symbols, repeats, lines = share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")
    letters, upper, short, mean = share("n_letters", "word_chars"), share("n_upper", "n_letters"), share("n_short", "n_words"), share("word_chars", "n_words")
    return {
        "symbols": (symbols > 0.1, symbols < 0.02),
        "repeats": (repeats > 0.2, repeats < 0.05),
        "lines": (lines > 0.3, lines == 0),
        "length": (F.col("n_words") < 10, F.col("n_words") >= 50),
        "letters": (letters < 0.6, letters > 0.8),
        "upper": (upper > 0.4, upper < 0.15),
        "short_words": (short < 0.02, short > 0.1),
        "word_length": ((mean < 2) | (mean > 15), (mean >= 3) & (mean <= 10)),
    }


def votes(counts: DataFrame) -> DataFrame:
    """The rows with `pattern`: for each rule -, 0 or + in the order of rules()."""
    cast = [F.when(bad, "-").when(good, "+").otherwise("0") for bad, good in rules().values()]
    return counts.withColumn("pattern", F.concat(*cast))


def fit(patterns: dict[str, int], steps: int = 100) -> tuple[dict[str, float], dict[tuple[str, int], np.ndarray], float]:
    """Posterior chance of good for each pattern, the chances of each rule's votes in bad and good rows, and the share of good."""
    if not patterns:
        return {}, {}, GOOD
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    cast = {v: np.array([[c == v for c in p] for p in names], float) for v in "-0+"}
    rate = {k: np.full(cast["0"].shape[1], x) for k, x in START.items()}
    good = GOOD
    for _ in range(steps):
        logs = [np.log(good if k else 1 - good) + sum(cast[v] @ np.log(rate[v, k]) for v in "-0+") for k in (0, 1)]
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        for k, share in ((0, 1 - chance), (1, chance)):
            held = weight * share
            for v in "-0+":
                rate[v, k] = (held @ cast[v] + PRIOR * START[v, k]) / (held.sum() + PRIOR)
        good = float((weight @ chance + PRIOR * GOOD) / (weight.sum() + PRIOR))
    return dict(zip(names, chance.tolist(), strict=True)), rate, good


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, pattern, base_failed, chance (posterior of good) and kept for every row."""
    cast = cut(votes(document_counts(docs)))
    seen = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}  # at most 3 ** 8 rows
    chances, _, _ = fit(seen)
    table = docs.sparkSession.createDataFrame(list(chances.items()), "pattern string, chance double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = cast.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("chance") >= least))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chance")
