"""Token counts of a byte-level BPE by finite-state transducers.

Two deterministic transducers are compiled from the tokenizer file. The first reads character classes and marks where
pieces begin; long texts are cut in chunks, each chunk's map from every state to a state is computed for all chunks at
once, and a parallel prefix scan composes the maps into each chunk's true start state. The second reads the bytes of a
piece; each transition is annotated with how many more tokens the piece has after the byte than before it. It is
determinised on demand: its state holds, for each start from which a token may still grow, the node of the token trie, the
last token before that start, and the token count there. So a text's count is a sum over its transitions.
A null text counts as empty: no bytes, no tokens. Whole texts are counted, however long. Nothing is drawn or compared, so
there are no ties; rows that repeat are counted each for itself, an empty table gives no rows, other columns don't matter.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import vocabulary
from .common import documents, pick, slices

#: Characters in one chunk of the scan.
CHUNK = 256
#: States that the piece transducer holds before it is compiled afresh, in the middle of a piece too, and pieces that are read
#: in step: each may add a state before the next look, so a worker never holds more than both together.
STATES, LANES = 120_000, 20_000
#: A packed transition: the next state, and the gain plus GAIN in the low bits.
BITS, GAIN = 10, 512

# Character classes of the piece pattern: the letters of 's 't 're 've 'm 'll 'd stand alone.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, S1, R, V, L, E = range(11)
CLASSES = 11


@functools.cache
def class_ranges(path: str) -> list[tuple[int, int, int]]:
    """(first, last, class) of all code points, asked from the tokenizer file's own pre-tokenizer.

    It cuts a text of all code points in order wherever their class changes; one character of each piece is then held
    against a letter, a digit and a sign, and belongs with the one that it isn't cut from.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def of(c: str) -> int:
        return next((kind for kind, known in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(known + c)) == 1), BLANK)

    high = [*range(0x80, 0xD800), *range(0xE000, 0x110000)]
    out = [(c, c, of(chr(c))) for c in range(0x80)]
    for _, (a, b) in cut("".join(map(chr, high))):
        out.append((high[a], high[b - 1], of(chr(high[a]))))
    return out


def character_classes(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for first, last, kind in ranges:
        out[first : last + 1] = kind
    for c, kind in ((" ", SPACE), ("'", QUOTE), *((c, S1) for c in "stmd"), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[ord(c)] = kind
    return out


class PieceScanner:
    """Marks the characters at which a piece begins.

    A state says what the last characters were; a transition reads one class and marks whether pieces begin at this
    character, at the one before, or at the one before that (a mark may have to wait for the next character or two).
    """

    # Kind of the open piece.
    START, IN_L, IN_N, IN_O, ONE_SPACE, RUN_SPACE, RUN_BLANK, Q, Q_R, Q_V, Q_L, SHUT = range(12)
    N = 12
    NOW, BACK1, BACK2 = 1, 2, 4

    def __init__(self) -> None:
        self.to = np.zeros((self.N, CLASSES), np.uint8)
        self.marks = np.zeros((self.N, CLASSES), np.uint8)
        for state in range(self.N):
            for c in range(CLASSES):
                self.to[state, c], self.marks[state, c] = self._step(state, c)

    def _fresh(self, c: int) -> int:
        """The state after a character of class c that opens a piece."""
        if c == SPACE:
            return self.ONE_SPACE
        if c == BLANK:
            return self.RUN_BLANK
        if c == QUOTE:
            return self.Q
        return {NUMBER: self.IN_N, OTHER: self.IN_O}.get(c, self.IN_L)

    def _step(self, state: int, c: int) -> tuple[int, int]:
        letter, fresh = c in (LETTER, S1, R, V, L, E), (self._fresh(c), self.NOW)
        if state in (self.START, self.SHUT):
            return fresh
        if state == self.IN_L:
            return (self.IN_L, 0) if letter else fresh
        if state == self.IN_N:
            return (self.IN_N, 0) if c == NUMBER else fresh
        if state == self.IN_O:
            return (self.IN_O, 0) if c in (OTHER, QUOTE) else fresh
        if state == self.ONE_SPACE:  # a space opens what follows it
            if c in (SPACE, BLANK):
                return (self.RUN_SPACE if c == SPACE else self.RUN_BLANK), 0
            return (self.IN_O if c == QUOTE else self._fresh(c)), 0
        if state in (self.RUN_SPACE, self.RUN_BLANK):  # white space before other characters gives up its last one
            if c in (SPACE, BLANK):
                return (self.RUN_SPACE if c == SPACE else self.RUN_BLANK), 0
            if state == self.RUN_SPACE:  # the last space goes to the next piece
                return (self.IN_O if c == QUOTE else self._fresh(c)), self.BACK1
            return self._fresh(c), self.BACK1 | self.NOW
        if state == self.Q:  # an apostrophe that opens a piece
            if c == S1:
                return self.SHUT, 0
            if c in (R, V, L):
                return {R: self.Q_R, V: self.Q_V, L: self.Q_L}[c], 0
            return (self.IN_O, 0) if c in (OTHER, QUOTE) else fresh
        # An apostrophe and one of r, v, l: a piece if the right letter follows, else the letter begins a word.
        if c == (L if state == self.Q_L else E):
            return self.SHUT, 0
        return (self.IN_L, self.BACK1) if letter else (self._fresh(c), self.BACK1 | self.NOW)

    def begins(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True where a piece begins. first: the positions at which texts begin; there the state starts anew."""
        n = len(classes)
        if not n:
            return np.zeros(0, bool)
        rows = -(-n // CHUNK)
        grid = np.zeros(rows * CHUNK, np.uint8)
        grid[:n] = classes
        reset = np.zeros(rows * CHUNK, bool)
        reset[first] = True
        grid, reset = np.ascontiguousarray(grid.reshape(rows, CHUNK).T), np.ascontiguousarray(reset.reshape(rows, CHUNK).T)
        to = self.to.ravel()
        maps = np.tile(np.arange(self.N, dtype=np.uint8), (rows, 1))  # of each chunk: its end state for each start state
        for k in range(CHUNK):
            if reset[k].any():
                maps[reset[k]] = self.START
            maps = to[maps.astype(np.int16) * CLASSES + grid[k][:, None]]
        step = 1
        while step < rows:  # prefix scan: maps[i] becomes the map of all chunks up to i
            maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], 1)])
            step *= 2
        state = np.full(rows, self.START, np.uint8)
        state[1:] = maps[:-1, self.START]
        marks, emitted = self.marks.ravel(), np.zeros((CHUNK, rows), np.uint8)
        for k in range(CHUNK):
            state[reset[k]] = self.START
            at = state.astype(np.int16) * CLASSES + grid[k]
            emitted[k], state = marks[at], to[at]
        flat = emitted.T.ravel()[:n]
        out = (flat & self.NOW) > 0
        out[:-1] |= (flat[1:] & self.BACK1) > 0
        # White space that ends a text is one piece; an apostrophe with r, v or l that ends a text is two.
        ends = np.append(first[first > 0], n) - 1
        last = self._last_state(classes, out, ends)
        out[ends[last]] = True
        return out

    def _last_state(self, classes: np.ndarray, out: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True for texts that end within 'r, 'v or 'l where the apostrophe opened a piece."""
        ok = (ends > 0) & np.isin(classes[ends], (R, V, L))
        before = np.maximum(ends - 1, 0)
        return ok & (classes[before] == QUOTE) & out[before] & ~out[ends]


class PieceCounter:
    """The transducer over a piece's bytes, determinised on demand."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        to_bytes = lambda t: bytes(alphabet[c] for c in t)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.token_of = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.token_of.items()}
        self.rank, self.parts = {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = (self.token_of[to_bytes(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            c = self.token_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = r
            self.parts.setdefault(c, (a, b))
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in self.token_of.items():
            node = 0
            for byte in text:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][byte]
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.state_of = {((0, -1, 0),): 0}
        self.states = [((0, -1, 0),)]
        self.column = np.full(256, -1, np.int16)  # columns of the table go to bytes as they turn up
        self.columns = 0
        self.table = np.full((1024, 32), -1, np.int32)

    def add(self, key: tuple) -> int:
        """The number of a state."""
        if (found := self.state_of.get(key)) is None:
            found = self.state_of[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 4, self.table.shape[1]), -1, np.int32)])
        return found

    def forget(self, live: np.ndarray) -> np.ndarray:
        """Drops all states but those that pieces stand in; gives their new numbers."""
        kept, back = np.unique(live, return_inverse=True)
        keys = [self.states[s] for s in kept.tolist()]
        self.state_of, self.states = {((0, -1, 0),): 0}, [((0, -1, 0),)]
        self.table = np.full((1024, self.table.shape[1]), -1, np.int32)
        return np.array([self.add(k) for k in keys], np.int32)[back]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart: the merges of their bytes, taken together, never cross the border."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merge that came last on either side until the tokens at the border could have merged earlier or are bytes.
        limit = 1 << 60
        while True:
            if (r := self.rank.get((a, b))) is not None and r < limit:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            ra = self.rank[pa_] if pa_ else -1
            rb = self.rank[pb] if pb else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # at equal rank the left one is merged first, so the right one is undone first
                limit, a = ra, pa_[1]
            else:
                limit, b = rb + 1, pb[0]

    def compile(self, state: int, byte: int) -> None:
        """Adds one transition: grow every open start by the byte; the last token is the longest that fits before it."""
        grown, best = [], None
        for node, before, count in self.states[state]:  # from the earliest start
            if (child := self.children[node].get(byte)) is None:
                continue
            grown.append((child, before, count))
            if best is None and (t := self.token[child]) >= 0 and (before < 0 or self.compatible(before, t)):
                best = (t, count + 1)
        last, gain = best
        if not -GAIN <= gain < (1 << BITS) - GAIN or len(self.states) >= 1 << (31 - BITS):
            raise OverflowError(f"a transition's gain of {gain} or state {len(self.states)} exceeds its field")
        key = (*((n, b, c - gain) for n, b, c in grown if self.children[n]), (0, last, 0))
        self.table[state, self.column[byte]] = self.add(key) << BITS | gain + GAIN

    def open_columns(self, used: np.ndarray) -> None:
        for byte in used[self.column[used] < 0].tolist():
            self.column[byte] = self.columns
            self.columns += 1
        if self.columns > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full((len(self.table), -(-self.columns // 32) * 32 - self.table.shape[1]), -1, np.int32)], 1)

    def gains(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Token counts of the pieces data[start : start + length]."""
        if len(self.states) > STATES:
            self.reset()
        self.open_columns(np.unique(data))
        order = np.argsort(-length, kind="stable")
        out = np.empty(len(order), np.int64)
        for k in range(0, len(order), LANES):
            part = order[k : k + LANES]
            out[part] = self._gains(data, start[part], length[part])
        return out

    def _gains(self, data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The same of some pieces, the longest first."""
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        longest = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(longest), "left")  # lanes with a byte at each step
        for k in range(longest):
            m = int(active[k])
            if m <= 4:  # a few very long pieces: one byte after the other
                keys = [self.states[x] for x in state[:m].tolist()]
                for i in range(m):
                    total[i] += self._walk(self.add(keys[i]), data[at[i] + k : at[i] + left[i]])
                break
            if len(self.states) > STATES:
                state[:m] = self.forget(state[:m])
            byte, s = data[at[:m] + k], state[:m]
            column = self.column[byte]
            move = self.table[s, column]
            if (new := move < 0).any():
                for pair in np.unique(s[new].astype(np.int64) << 8 | byte[new]).tolist():
                    self.compile(pair >> 8, pair & 255)
                move = self.table[s, column]
            total[:m] += (move & (1 << BITS) - 1) - GAIN
            state[:m] = move >> BITS
        return total

    def _walk(self, state: int, data: np.ndarray) -> int:
        total = 0
        for byte in data.tolist():
            if (move := int(self.table[state, self.column[byte]])) < 0:
                if len(self.states) > STATES:
                    state = int(self.forget(np.array([state]))[0])
                self.compile(state, byte)
                move = int(self.table[state, self.column[byte]])
            total += (move & (1 << BITS) - 1) - GAIN
            state = move >> BITS
        return total


class TokenCounter:
    def __init__(self, path: str, ranges: list[tuple[int, int, int]]):
        self.classes, self.scanner, self.pieces = character_classes(ranges), PieceScanner(), PieceCounter(path)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text. A special token's string counts as one token wherever it stands."""
        owner, parts, tokens = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = [text]
            for special in self.pieces.special:
                if special in text:
                    found = [y for x in found for y in x.split(special)]
            tokens[i] = len(found) - 1
            parts += found
            owner += [i] * len(found)
        whole = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        wide = (1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(wide)])
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        full = np.flatnonzero(sizes)
        begins = np.flatnonzero(self.scanner.begins(self.classes[points], text_at[full]))
        start = offset[begins]
        counts = self.pieces.gains(data, start, np.diff(np.append(start, len(data))))
        of = np.asarray(owner)[np.searchsorted(text_at, begins, "right") - 1]
        np.add.at(tokens, of, counts)
        size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        return size, tokens


_loaded: dict[str, TokenCounter] = {}


def load(path: str, ranges: list[tuple[int, int, int]] | None = None) -> TokenCounter:
    """One counter for each file and worker. ranges: those of class_ranges, if they are known already."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path, ranges or class_ranges(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of the whole text of every row; map-only.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids stay as they are.
    """

    ranges = class_ranges(vocabulary(file))  # about two thousand; found once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary(file), ranges)
        for part in slices(batches, most=2 << 20):
            size, tokens = counter.count([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
