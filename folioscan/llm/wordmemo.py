"""A worker's memo from words to ids that is kept and probed in numpy arrays, without an object for each word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words of up to so many bytes are kept; longer ones are rare and go to the coder each time.
KEPT = 24
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def join(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts one after the other as bytes, and where each begins (with the end)."""
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[0], start[0]+1, ... of all ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each word as three integers (exact up to KEPT bytes), and a hash of these and the length."""
    wide = np.concatenate([data, np.zeros(KEPT + 8, np.uint8)])
    eight = np.ndarray((len(data) + KEPT + 1,), "<u8", buffer=wide, strides=(1,))  # the eight bytes from each place on
    exact = np.empty((3, len(start)), np.uint64)
    for i in range(3):
        exact[i] = eight[start + 8 * i] & _MASK[np.clip(length - 8 * i, 0, 8)]
    h = length.astype(np.uint64) * _MIX[3]
    for i in range(3):
        h = (h ^ exact[i]) * _MIX[i]
        h ^= h >> np.uint64(29)
    return exact, h


class WordMemo:
    """An open-addressed table from words to ids. new: gives the ids of some words, all in one array, and how many each has.

    It holds at most `most` words and `most_ids` ids, and starts afresh when it would hold more.
    """

    def __init__(self, new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 500_000, most_ids: int = 4_000_000):
        self.new, self.most, self.most_ids = new, most, most_ids
        self.bits = int(np.ceil(np.log2(2 * most)))
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.words = 0
        self.hash = np.empty(1024, np.uint64)
        self.exact = np.empty((3, 1024), np.uint64)
        self.at, self.n, self.length = (np.empty(1024, np.int32) for _ in range(3))
        self.ids, self.held = np.empty(1 << 14, "<u4"), 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, exact: np.ndarray, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place of each word in the memo, or -1."""
        out = np.full(len(h), -1, np.int32)
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            at = self.slots[slot[todo]]
            full = at >= 0
            todo, at = todo[full], at[full]
            same = (self.hash[at] == h[todo]) & (self.length[at] == length[todo]) & (self.exact[0, at] == exact[0, todo]) & (self.exact[1, at] == exact[1, todo]) & (self.exact[2, at] == exact[2, todo])
            out[todo[same]] = at[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, exact: np.ndarray, h: np.ndarray, length: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Puts words, none of them twice or known, into the table."""
        first = self.words
        self.words += len(h)
        size = len(self.hash)
        if self.words > size:
            more = max(self.words - size, size // 2)
            self.hash = np.concatenate([self.hash, np.empty(more, np.uint64)])
            self.exact = np.concatenate([self.exact, np.empty((3, more), np.uint64)], 1)
            self.at, self.n, self.length = (np.concatenate([x, np.empty(more, np.int32)]) for x in (self.at, self.n, self.length))
        part = slice(first, self.words)
        self.hash[part], self.exact[:, part], self.length[part], self.at[part], self.n[part] = h, exact, length, at, n
        place, slot = np.arange(first, self.words, dtype=np.int32), self._slot(h)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]  # of several words for one slot the last one stays
            put = self.slots[slot] == place
            place, slot = place[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def encode(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many ids each has."""
        exact, h = keys(data, start, length)
        place = self.find(exact, h, length)
        at, n = self.at[place].astype(np.int64), self.n[place].astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if not len(missing):
            return self.ids[ragged(at, n)], n
        short = missing[length[missing] <= KEPT]
        _, first, which = np.unique(h[short], return_index=True, return_inverse=True)
        fresh = short[first]
        # Words of one hash that differ in their bytes, and long words, are looked up one by one and not kept.
        same = (length[short] == length[fresh][which]) & (exact[:, short] == exact[:, fresh[which]]).all(0)
        strange = np.concatenate([missing[length[missing] > KEPT], short[~same]])
        some = np.concatenate([fresh, strange])
        found, sizes = self.new([data[a : a + b].tobytes() for a, b in zip(start[some].tolist(), length[some].tolist(), strict=True)])
        if self.held + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.empty(len(found) + len(self.ids) // 2, "<u4")])
        self.ids[self.held : self.held + len(found)] = found
        begins = self.held + np.cumsum(sizes) - sizes
        at[short], n[short] = begins[which], sizes[which]
        at[strange], n[strange] = begins[len(fresh) :], sizes[len(fresh) :]
        out = self.ids[ragged(at, n)]
        kept = int(sizes[: len(fresh)].sum())
        if self.words + len(fresh) > self.most or self.held + kept > self.most_ids:
            self.clear()
        else:
            self._add(exact[:, fresh], h[fresh], length[fresh], begins[: len(fresh)], sizes[: len(fresh)])
            self.held += kept
        return out, n


#: ASCII white space.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of bytes other than ASCII white space."""
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2] - turns[::2]


def word_ids(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, and only these, have equal numbers."""
    exact, h = keys(data, start, length)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    odd = (length > KEPT) | (length != length[first][which]) | (exact != exact[:, first[which]]).any(0)
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        which[i] = len(first) + own.setdefault(data[start[i] : start[i] + length[i]].tobytes(), len(own))
    return which


def texts_as_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each with a line feed behind it, and where each begins (with the end)."""
    return join([t.encode("utf-8", "replace") + b"\n" for t in texts])
