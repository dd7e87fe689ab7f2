"""Similarity of a short text to the best stretch of a long one."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Parts of this length or more are matched by the letters that make up at most a hundredth of a stretch: the measure's rule.
LONG = 200
#: Stretches of long parts whose letters promise most, which are scored before the others; comparisons that are held at a time; windows
#: of a step.
FIRST, CELLS, STEP = 32, 100_000, 4_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Windows:
    """The stretches text[w : w + n] of one text, to be compared with a part of n code points (LONG at least) by matching blocks.

    The longest block of a stretch is taken first (of equal ones the first in the part, then in the text), then the longest
    ones to its left and to its right, and so on. Blocks of all stretches are parts of the same few runs of equal code points,
    so the runs are listed once, and each round finds the longest piece of a run in every open rectangle of every stretch. A
    stretch is given up when what it has and what its open rectangles could add don't exceed the best one so far.
    """

    def __init__(self, part: np.ndarray, text: np.ndarray):
        self.part, self.text, self.n = part, text, len(part)
        letters, self.a = np.unique(part, return_inverse=True)
        place = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        self.t = np.where(letters[place] == text, place, -1)
        self.k = len(letters)
        windows = len(text) - self.n + 1
        held = np.zeros((self.k, len(text) + 1), np.int32)
        held[self.t[self.t >= 0], np.flatnonzero(self.t >= 0) + 1] = 1
        held = held.cumsum(1, dtype=np.int32)
        counts = held[:, self.n :] - held[:, :windows]
        #: The letters that each stretch shares with the part: what blocks can make at most.
        self.bound = np.minimum(counts, np.bincount(self.a, minlength=self.k)[:, None]).sum(0)
        if self.n >= LONG:
            self.rare = (counts <= self.n // 100 + 1).T
        self._cells()

    def _cells(self) -> None:
        """Places (i of the part, j of the text) of equal code points, by diagonal, with the run that each stands in."""
        keep = self.rare.any(0) if self.n >= LONG else np.ones(self.k, bool)
        at = [(np.flatnonzero(self.a == c), np.flatnonzero(self.t == c)) for c in np.flatnonzero(keep)]
        none = [np.zeros(0, np.int64)]
        i = np.concatenate([np.repeat(x, len(y)) for x, y in at] or none)
        j = np.concatenate([np.tile(y, len(x)) for x, y in at] or none)
        order = np.lexsort((i, j - i))
        self.i, self.j = i[order], j[order]
        if self.n < LONG:
            return
        # How far equal code points, frequent ones too, go on before and behind.
        self.first, self.last = self.i.copy(), self.i + 1
        for step, edge in ((-1, self.first), (1, self.last)):
            live = np.arange(len(self.i))
            while len(live):
                x = edge[live] - (step < 0)
                y = x + (self.j - self.i)[live]
                inside = (x >= 0) & (x < self.n) & (y >= 0) & (y < len(self.t))
                live, x, y = live[inside], x[inside], y[inside]
                live = live[self.a[x] == self.t[y]]
                edge[live] += step

    def _runs(self, rare: np.ndarray) -> tuple[np.ndarray, ...]:
        """i, j, length, and where the equal code points around begin and end, of runs of letters that count."""
        keep = np.flatnonzero(rare[self.a[self.i]])
        i, j = self.i[keep], self.j[keep]
        new = np.ones(len(i), bool)
        new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(i)))
        return i[starts], j[starts], size, self.first[keep][starts], self.last[keep][starts]

    def _start(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """What is equal at the very start of rectangles in which no run begins: the measure counts it too."""
        out, live = np.zeros(len(alo), np.int64), np.arange(len(alo))
        while len(live):
            live = live[(alo[live] + out[live] < ahi[live]) & (blo[live] + out[live] < bhi[live])]
            live = live[self.a[alo[live] + out[live]] == self.t[blo[live] + out[live]]]
            out[live] += 1
        return out

    def score(self, windows: np.ndarray, best: int) -> int:
        """The most code points that blocks make in one of the stretches, or `best` if none has more."""
        kind = np.zeros(len(windows), np.int64)
        for bits in np.packbits(self.rare[windows], axis=1).T:
            _, first, kind = np.unique(kind << 8 | bits, return_index=True, return_inverse=True)
        runs = [self._runs(self.rare[w]) for w in windows[first]]
        runs = [tuple(x[order] for x in r) for r in runs for order in (np.argsort(r[1], kind="stable"),)]
        place = np.concatenate([(np.int64(k) << 32) + r[1] for k, r in enumerate(runs)])
        runs = [np.concatenate(x) for x in zip(*runs, strict=True)]
        longest = int(runs[2].max(initial=1))
        win, found = np.arange(len(windows)), np.zeros(len(windows), np.int64)
        alo, ahi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n)
        blo, bhi = windows.copy(), windows + self.n
        while len(win):
            # Only runs that reach into a rectangle's stretch of the text are looked at.
            start = np.searchsorted(place, (kind[win] << 32) + np.maximum(blo - longest + 1, 0))
            count = np.searchsorted(place, (kind[win] << 32) + bhi) - start
            total, lo, got = np.cumsum(count), 0, []
            while lo < len(win):
                up = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CELLS, side="right")))
                got.append(self._longest(np.arange(lo, up), start[lo:up], count[lo:up], alo, ahi, blo, bhi, runs))
                lo = up
            hit, hi, hj, hl = (np.concatenate(x) for x in zip(*got, strict=True))
            np.add.at(found, win[hit], hl)
            rest = np.ones(len(win), bool)
            rest[hit] = False
            small = self._start(alo[rest], ahi[rest], blo[rest], bhi[rest])
            np.add.at(found, win[rest], small)
            parts = [np.concatenate(x) for x in ((win[hit], win[hit]), (alo[hit], hi + hl), (hi, ahi[hit]), (blo[hit], hj + hl), (hj, bhi[hit]))]
            least = np.minimum(parts[2] - parts[1], parts[4] - parts[3])
            could = found + np.bincount(parts[0], np.maximum(least, 0), len(found)).astype(np.int64)
            open_ = (least > 0) & (could > best)[parts[0]]
            win, alo, ahi, blo, bhi = (x[open_] for x in parts)
        return max(best, int(found.max(initial=0)))

    def _longest(self, item, start, n, alo, ahi, blo, bhi, runs):
        """The rectangles that hold a run, and the block that is taken there."""
        item, start, n = item[n > 0], start[n > 0], n[n > 0]
        if not len(item):
            return (np.zeros(0, np.int64),) * 4
        ri, rj, rl, rf, re = runs
        starts = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(item)), n)
        run = np.arange(len(owner)) - np.repeat(starts - start, n)
        own = item[owner]
        i, j = ri[run], rj[run]
        cut = np.maximum(np.maximum(alo[own] - i, blo[own] - j), 0)
        size = np.minimum(np.minimum(ahi[own] - i, bhi[own] - j), rl[run]) - cut
        order = np.where(size > 0, (size << 42) | ((1 << 21) - 1 - i - cut << 21) | ((1 << 21) - 1 - j - cut), 0)
        best = np.maximum.reduceat(order, starts)
        at = np.flatnonzero((order == best[owner]) & (order > 0))
        own, run = own[at], run[at]
        shift = rj[run] - ri[run]
        # A run goes on by equal code points around it that don't count by themselves.
        first = np.maximum(np.maximum(alo[own], blo[own] - shift), rf[run])
        last = np.minimum(np.minimum(ahi[own], bhi[own] - shift), re[run])
        return own, first, first + shift, last - first


class Shorts(Windows):
    """The same for a part shorter than LONG, whose runs are the same for all stretches.

    Stretches side by side have most of their blocks in common. The longest block of every stretch comes from a sliding maximum.
    To its left lie rectangles that differ by their left edge alone, to its right such that differ by their right one, and
    between blocks equal ones: rectangles with three edges in common are looked at once, by a running maximum from the common
    edge over places of runs, and equal ones are one.
    """

    def __init__(self, part: np.ndarray, text: np.ndarray):
        super().__init__(part, text)
        new = np.ones(len(self.i), bool)
        new[1:] = (self.j[1:] - self.i[1:] != self.j[:-1] - self.i[:-1]) | (self.i[1:] != self.i[:-1] + 1)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(self.i)))
        behind = np.arange(len(self.i)) - np.repeat(starts, size) + 1
        ahead = np.repeat(size, size) - behind + 1
        #: The next place of each letter in the text and in the part (no letter comes last), for blocks of one.
        self.next, self.back = self._following(self.t), self._following(self.a)
        self.longest = int(size.max(initial=0))
        #: Begins and ends (of the part, of the text) of blocks of two or more, and how long they go on, by places of the text.
        self.begins = self._by_place(self.i, self.j, ahead)
        self.ends = self._by_place(self.i + 1, self.j + 1, behind)

    def _following(self, letters: np.ndarray) -> np.ndarray:
        out = np.full((self.k + 1, len(letters) + 1), len(letters), np.int32)
        for c in range(self.k):
            at = np.flatnonzero(letters == c)
            out[c, : at[-1] + 1 if len(at) else 0] = np.repeat(at, np.diff(at, prepend=-1))
        return out

    @staticmethod
    def _by_place(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        keep = np.flatnonzero(size > 1)
        keep = keep[np.argsort(j[keep], kind="stable")]
        return i[keep], j[keep], size[keep]

    @staticmethod
    def _order(size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest first, then the first of the part, then of the text; LONG and STEP bound them."""
        return size << 21 | 255 - i << 13 | 8191 - j

    def _single(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Blocks of one letter in rectangles that hold no longer ones: each letter of the part takes the next one of the text.

        Such rectangles are small one way. Where that is the text's, the next letter of the part is looked for by those of the text.
        """
        out, at, step = np.zeros(len(alo), np.int64), blo.copy(), 0
        flat = bhi - blo < ahi - alo
        live = np.flatnonzero(~flat)
        while len(live):
            hit = self.next[self.a[alo[live] + step], at[live]]
            yes = hit < bhi[live]
            out[live[yes]] += 1
            at[live[yes]] = hit[yes] + 1
            step += 1
            live = live[(alo[live] + step < ahi[live]) & (at[live] < bhi[live])]
        live, of = np.flatnonzero(flat), alo.copy()
        while len(live):
            best, to = np.full(len(live), self.n), at[live]
            for step in range(int((bhi[live] - at[live]).max())):
                y = at[live] + step
                wide = np.flatnonzero(y < bhi[live])
                x, y = self.back[self.t[y[wide]], of[live[wide]]], y[wide]
                less = x < best[wide]
                best[wide[less]], to[wide[less]] = x[less], y[less]
            hit = best < ahi[live]
            live = live[hit]
            out[live] += 1
            of[live], at[live] = best[hit] + 1, to[hit] + 1
            live = live[(of[live] < ahi[live]) & (at[live] < bhi[live])]
        return out

    def _whole(self) -> np.ndarray:
        """The block that is taken first in each stretch."""
        i, j, size = self.begins
        windows = len(self.t) - self.n + 1
        out = np.zeros(windows, np.int64)
        if not len(i):
            return out
        place, first = np.unique(j, return_index=True)
        width = self.n - self.longest + 1  # of places where no block can reach over a stretch's end
        most = np.zeros(len(self.t), np.int64)
        most[place] = np.maximum.reduceat(self._order(size, i, j), first)
        held = 1
        while 2 * held <= width:
            most = np.maximum(most[:-held], most[held:])
            held *= 2
        out = np.maximum(most[:windows], most[width - held : width - held + windows])
        for left in range(2, self.longest):  # blocks that a stretch's end may cut
            cut = np.zeros(len(self.t), np.int64)
            cut[place] = np.maximum.reduceat(self._order(np.minimum(size, left), i, j), first)
            np.maximum(out, cut[self.n - left :][:windows], out)
        return out

    def _taken(self, left: bool, alo: np.ndarray, ahi: np.ndarray, edge: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The block that is taken in each rectangle, in order of alo, ahi, edge and own; `own` is the left edge if `left`, else the right."""
        if not len(own):
            return own
        new = np.ones(len(own), bool)
        new[1:] = (alo[1:] != alo[:-1]) | (ahi[1:] != ahi[:-1]) | (edge[1:] != edge[:-1])
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        last = np.append(first[1:], len(own)) - 1
        i, j, size = self.begins if left else self.ends
        side = "left" if left else "right"
        start = np.searchsorted(j, own[first] if left else edge[first], side)
        n = np.searchsorted(j, edge[first] if left else own[last], side) - start
        out, total, lo = np.zeros(len(own), np.int64), np.cumsum(n), 0
        while lo < len(first):
            up = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CELLS, side="right")))
            m = n[lo:up]
            base = np.cumsum(m) - m
            group = np.repeat(np.arange(up - lo), m)
            run = np.arange(len(group)) + np.repeat(start[lo:up] - base, m)
            at = group + lo
            x, y = i[run], j[run]
            low, high, fixed = alo[first[at]], ahi[first[at]], edge[first[at]]
            if left:
                held = np.minimum(np.minimum(size[run], high - x), fixed - y)
                fits = (x >= low) & (held > 1)
            else:
                held = np.minimum(np.minimum(size[run], x - low), y - fixed)
                fits = (x <= high) & (held > 1)
                x, y = x - held, y - held
            order = np.where(fits, self._order(held, x, y), 0)
            told = slice(first[lo], last[up - 1] + 1)
            mine = of[told] - lo
            place = np.searchsorted(j, own[told], side) - start[of[told]]
            if left:
                most = np.maximum.accumulate((order | (up - lo - 1 - group) << 29)[::-1])[::-1]
                inside = place < m[mine]
            else:
                most = np.maximum.accumulate(order | group << 29)
                place = place - 1
                inside = place >= 0
            got = np.zeros(len(mine), np.int64)
            got[inside] = most[(base[mine] + place)[inside]] & (1 << 29) - 1
            out[told] = got
            lo = up
        return out

    def score(self, windows: np.ndarray, best: int) -> int:
        """The most code points that blocks make in one of the stretches, or `best` if none has more."""
        block = self._whole()[windows]
        blo, alo, ahi, bhi = windows, np.zeros(len(windows), np.int64), np.full(len(windows), self.n), windows + self.n
        split, levels = len(blo), []  # from `split` on it is the right edges that differ
        root = True
        while len(blo):
            if not root:
                block = np.concatenate([self._taken(True, alo[:split], ahi[:split], bhi[:split], blo[:split]), self._taken(False, alo[split:], ahi[split:], blo[split:], bhi[split:])])
            size, i, j = block >> 21, 255 - (block >> 13 & 255), 8191 - (block & 8191)
            own = size.copy()
            none = size == 0
            own[none] = self._single(alo[none], ahi[none], blo[none], bhi[none])
            before = np.flatnonzero(~none & (i > alo) & (j > blo))
            behind = np.flatnonzero(~none & (i + size < ahi) & (j + size < bhi))
            # Left of a block the left edge stays what it was, right of it the right one; what lies between blocks goes with the first.
            ends = behind if root else behind[behind >= split]
            inner = behind[:0] if root else behind[behind < split]
            a = [np.concatenate(x) for x in ((alo[before], (i + size)[inner]), (i[before], ahi[inner]), (j[before], bhi[inner]), (blo[before], (j + size)[inner]))]
            b = [(i + size)[ends], ahi[ends], (j + size)[ends], bhi[ends]]
            a, of_a = self._distinct(a)
            b, of_b = self._distinct(b)
            levels.append((own, np.concatenate([before, inner, ends]), np.concatenate([of_a, of_b + len(a[0])])))
            split = len(a[0])
            alo, ahi, blo, bhi = (np.concatenate(x) for x in ((a[0], b[0]), (a[1], b[1]), (a[3], b[2]), (a[2], b[3])))
            root = False
        found = np.zeros(0, np.int64)
        for own, above, below in reversed(levels):
            found = own + np.bincount(above, found[below], len(own)).astype(np.int64)
        return max(best, int(found.max(initial=0)))

    @staticmethod
    def _distinct(rects: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each of the rectangles once, in their order, and where each one went."""
        key = ((rects[0] << 8 | rects[1]) << 13 | rects[2]) << 13 | rects[3]
        key, of = np.unique(key, return_inverse=True)
        return [key >> 34, key >> 26 & 255, key >> 13 & 8191, key & 8191], of


def window_ratio(texts: str | Iterable[str], part: str) -> float:
    """The best matching-blocks ratio of `part` with any stretch of its length of one of the texts; 0 if all are shorter.

    Texts are read one behind the other, so that what one has needn't be looked for below that in the next.
    """
    texts, n = [texts] if isinstance(texts, str) else list(texts), len(part)
    if any(part in t for t in texts):
        return 1.0
    a, best, most = _codes(part), 0, STEP + n - 1
    held, size = [], 0
    pieces = (t[at : at + most] for t in map(_codes, texts) for at in range(0, len(t) - n + 1, STEP))
    for piece in chain(pieces, [None]):
        if held and (piece is None or size + len(piece) > most):
            best = _best(a, held, best)
            held, size = [], 0
        if piece is not None:
            held.append(piece)
            size += len(piece) + 1
    return best / n if n else 0.0


def _best(a: np.ndarray, pieces: list[np.ndarray], best: int) -> int:
    """The most code points that blocks make in a stretch of one of the pieces, or `best` if none has more."""
    n, none = len(a), np.full(1, 0xFFFFFFFF, np.uint32)  # no code point
    text = np.concatenate([x for p in pieces for x in (p, none)][:-1])
    first = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    windows = np.concatenate([np.arange(at, at + len(p) - n + 1) for at, p in zip(first, pieces, strict=True)])
    found = (Windows if n >= LONG else Shorts)(a, text)
    order = windows if n < LONG else windows[np.argsort(-found.bound[windows], kind="stable")]
    for windows in (order[:FIRST], order[FIRST:]) if n >= LONG else (order,):
        windows = windows[found.bound[windows] > best]
        if len(windows):
            best = found.score(windows, best)
    return best


@F.pandas_udf(DoubleType())
def _window_scores(texts: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([math.log2(1 + window_ratio((t.lower() for t in ts), p.lower())) for ts, p in zip(texts, part, strict=True)], dtype="float64")


def window_score(text: Column, part: Column) -> Column:
    """log2(1 + best ratio), letter case ignored; null texts count as empty. Contained parts never leave the JVM."""
    return best_window_score(F.array(text), part)


def best_window_score(texts: Column, part: Column) -> Column:
    """The same for the best of an array of texts."""
    p = F.coalesce(part, F.lit(""))
    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    inside = F.exists(texts, lambda t: F.contains(F.lower(t), F.lower(p)))
    # Rows that the JVM decides send no texts to Python.
    slow = _window_scores(F.when(inside, F.array().cast("array<string>")).otherwise(texts), F.when(inside, F.lit("")).otherwise(p))
    return F.when(inside, 1.0).otherwise(slow)


def chunk_score(best: Column) -> Column:
    """A question's score from its best window score; the logarithm is taken once more, as the measure is defined."""
    return F.log2(1 + F.coalesce(best, F.lit(0.0)))
