"""Where texts hold any of many given strings: an automaton over all of them, run over batches of texts in Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Code points of the strings in one automaton: what the driver and each task hold at a time. A longer string has its own.
BLOCK = 200_000
#: Code points that a task reads in step, and those of one stretch of a text; texts that it holds at a time.
BATCH, STRETCH, TEXTS = 2 << 20, 4096, 1024


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Automaton:
    """States are the prefixes of the strings, which differ and aren't empty; 0 is the empty one.

    `move` leads from a state, by the class of a code point, to the longest prefix that then ends there. `told` is the string
    that a state is, or -1; `shorter` is the longest proper suffix of a state that is a string, or 0.
    """

    def __init__(self, strings: list[str]):
        self.sizes = np.array([len(s) for s in strings])
        flat = np.concatenate([code_points(s) for s in strings])
        known, letters = np.unique(flat, return_inverse=True)
        self.classes = np.zeros(0x110000, np.uint16 if len(known) < 1 << 16 else np.uint32)
        self.classes[known] = np.arange(1, len(known) + 1)
        k, first = len(known) + 1, np.cumsum(self.sizes) - self.sizes
        # Level by level: strings with a common prefix share its state.
        held, state, n = np.arange(len(strings)), np.zeros(len(strings), np.int64), 1
        levels, ends = [], np.full(len(flat) + 1, -1)
        while len(held):
            edge, child = np.unique(state[held] * k + letters[first[held] + len(levels)] + 1, return_inverse=True)
            levels.append((np.arange(n, n + len(edge)), edge // k, edge % k))
            state[held] = n + child
            n += len(edge)
            done = self.sizes[held] == len(levels)
            ends[state[held[done]]] = held[done]
            held = held[~done]
        self.told = ends[:n]
        self.move, self.shorter, back = np.zeros((n, k), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.move[0, levels[0][2]] = levels[0][0]
        for depth, (states, parents, steps) in enumerate(levels):
            if depth:  # the longest proper suffix that is a prefix: the parent's, one step on
                back[states] = self.move[back[parents], steps]
            self.move[states] = self.move[back[states]]
            if depth + 1 < len(levels):
                below, parents, steps = levels[depth + 1]
                self.move[parents, steps] = below
            self.shorter[states] = np.where(self.told[back[states]] >= 0, back[states], self.shorter[back[states]])
        self.ends = (self.told >= 0) | (self.shorter > 0)

    def first(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, string and start of the first place of each string in each text; all texts are read in step.

        A stretch of a text begins early enough to stand in the right state where its own part begins.
        """
        n = np.array([len(t) for t in texts])
        classes = self.classes[code_points("".join(texts))]
        first, lead = np.cumsum(n) - n, int(self.sizes.max()) - 1
        size = max(STRETCH, 4 * lead)
        parts = -(-n // size)
        text = np.repeat(np.arange(len(n)), parts)
        own = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
        begin = np.maximum(0, own - lead)
        order = np.argsort(begin - np.minimum(own + size, n[text]), kind="stable")  # longest first
        text, own, begin = text[order], own[order], begin[order]
        length = np.minimum(own + size, n[text]) - begin
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        at, state, hits = first[text] + begin, np.zeros(len(text), np.int32), []
        for step, m in enumerate(live.tolist()):
            state = self.move[state[:m], classes[at[:m] + step]]
            found = np.flatnonzero(self.ends[state])
            if len(found):
                hits.append((found, np.full(len(found), step), state[found]))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        lane, step, state = (np.concatenate(x) for x in zip(*hits, strict=True))
        end = begin[lane] + step + 1
        mine = end > own[lane]  # what ends before is found in the stretch before
        lane, end, state = lane[mine], end[mine], state[mine]
        out = []
        while len(state):
            string = self.told[state]
            yes = string >= 0
            out.append((text[lane[yes]], string[yes], end[yes] - self.sizes[string[yes]]))
            state = self.shorter[state]
            lane, end, state = lane[state > 0], end[state > 0], state[state > 0]
        text, string, start = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((start, string, text))
        text, string, start = text[order], string[order], start[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (string[1:] != string[:-1])
        return text[new], string[new], start[new]


def pieces(texts: list[str], lead: int) -> Iterator[list[tuple[int, int, str]]]:
    """(text, offset, piece) in groups of about BATCH code points; pieces of one text overlap by `lead`."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BATCH):
            piece = text[max(0, at - lead) : at + BATCH]
            if held and size + len(piece) > BATCH:
                yield held
                held, size = [], 0
            held.append((i, max(0, at - lead), piece))
            size += len(piece)
    if held:
        yield held


def _spans(docs: DataFrame, key: str, strings: list[str], ids: list[list[int]]) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast((strings, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, ids = given.value
        automaton = Automaton(strings)
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            texts, best = [t or "" for t in batch.column("text").to_pylist()], {}
            for group in pieces(texts, int(automaton.sizes.max()) - 1):
                for p, s, start in zip(*(x.tolist() for x in automaton.first([x[2] for x in group])), strict=True):
                    i, offset, _ = group[p]
                    best[i, s] = min(best.get((i, s), 1 << 60), offset + start)
            rows = [(i, item, at, at + len(strings[s])) for (i, s), at in best.items() for item in ids[s]]
            if rows:
                i, item, start, end = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(key).take(pa.array(i)), *(pa.array(x, pa.int64()) for x in (item, start, end))], [key, "item_id", "start", "end"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, item_id long, start long, end long")


def first_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item_id, start, end: the first place in each text of every item (item_id, text) that it holds, in code points.

    Texts stay where they are and are read once for each BLOCK of items; only items travel, a block at a time. Empty and null
    items stand nowhere; items of equal texts stand at the same place. Rows that repeat a key are read each for itself.
    """
    found, strings, size = None, {}, 0
    rows = items.filter(F.length("text") > 0).select("item_id", "text").toLocalIterator()
    for row in chain(rows, [None]):
        if row is None or (size and size + len(row["text"]) > BLOCK):
            if strings:
                part = _spans(docs, key, list(strings), list(strings.values()))
                found = part if found is None else found.unionByName(part)
            strings, size = {}, 0
        if row is not None:
            size += len(row["text"]) * (row["text"] not in strings)
            strings.setdefault(row["text"], []).append(row["item_id"])
    if found is None:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, item_id long, start long, end long")
    return found


def one_span(docs: DataFrame, found: DataFrame, draw: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, item_id, start, end: one of a text's spans; item -1 and (0, 0) for a text without any.

    Without `draw` it is the one that stands first, of equal ones that of the least item. `draw`, an SQL expression over n and
    the key, says which of a text's n items counts, from 0 in the order of their numbers: a reproducible random choice.
    """
    if draw is None:
        best = found.groupBy(key).agg(F.min(F.struct("start", "item_id", "end")).alias("f"))
    else:
        by_key = Window.partitionBy(key)
        ranked = found.withColumns({"n": F.count("*").over(by_key), "rank": F.row_number().over(by_key.orderBy("item_id", "start")) - 1})
        best = ranked.filter(F.col("rank") == F.expr(draw)).select(key, F.struct("start", "item_id", "end").alias("f"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("f.item_id", F.lit(-1)).cast("long").alias("item_id"), zero(F.col("f.start")).alias("start"), zero(F.col("f.end")).alias("end"))
