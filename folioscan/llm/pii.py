"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained in numpy on a small labelled table of made-up data (`labelled`) and decoded by Viterbi in padded batches.
A span holds a digit, an at sign or a spelt-out one; so only windows are decoded, of words that hold one of these and GAP
words on either side, however long they are. A run of more than 64 characters without blanks is split into words at punctuation that no span holds and at
characters of scripts without blanks. The field alone decides on its spans, by features that tell among others whether a
run of numbers passes Luhn's rule; they are kept where they don't touch a span of the patterns, which stay.
A null or empty text has no spans, a very long one is read whole. Of equally likely tags the first in order of TAGS is taken.
Spans are in code points, ends exclusive. Rows that repeat are read each for itself, an empty table gives no rows, and other
columns, also with clashing names, stay as they are in `redact` and don't matter else.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_rows, pick, slices

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words kept on either side of a word that may be in a span.
GAP = 3
#: Words, with those that pad, which are decoded together.
STEP = 1 << 16
WORD = re.compile(r"\S+")
TAIL = re.compile(r"\S*")
#: A run without blanks that is split, and the characters that it is split at.
LONG = re.compile(r"(?<!\S)\S{65,}")
SPLIT = re.compile(r"[,;:|\"'`<>{}=/\\&?!#*\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2010-\u206f\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
TRIGGER = re.compile(r"[0-9@]+|[\[(]at[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the e-mail pattern, found from the at signs so that long words cost no more."""
    out, free, i = [], 0, text.find("@")
    while i >= 0:
        before = text[free:i]
        start = free + len(before.rstrip(LOCAL))
        if start < i and (m := DOMAIN.match(text, i + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = i + 1
        i = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, leftmost and non-overlapping for each kind, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    runs = [m.span() for m in DIGITS.finditer(text)]
    if runs:
        i = 0
        while i + 3 < len(runs):  # four runs of digits with single dots between them
            if all(runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] == "." for j in (i, i + 1, i + 2)):
                if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in runs[i : i + 4]):
                    out.append((runs[i][0], 1, runs[i + 3][1]))
                i += 4
            else:
                i += 1
        i = 0
        while i < len(runs):  # runs joined by single blanks or hyphens
            j, n = i, runs[i][1] - runs[i][0]
            while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
                j += 1
                n += runs[j][1] - runs[j][0]
            if 14 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
                out.append((runs[i][0], 2, runs[j][1]))
            i = j + 1
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def shape(word: str) -> str:
    """Letters as a, digits as 9 and how many, other characters as they are; runs of letters count once."""
    core = re.sub(r"[^\W\d_]+", "a", word)[:64]
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 17)}", core)


#: Words of digits and what stands between them in numbers; an address; the end of a host; a number with its area first.
NUMERIC = re.compile(r"[0-9().+/-]*[0-9][0-9().+/-]*")
FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
HOST = re.compile(r"\.[A-Za-z]{2}|[\[(]dot[\])]")
AREA = re.compile(r"\+|\(?[0-9]{3}[)\s.-]")
AT = re.compile(r"[\[(]at[\])]")
EDGES = ".,;:!?|\"'"


def features(words: list[str]) -> list[list[str]]:
    """What the field sees of each word: its shape and its neighbours', and what the run of numbers that it stands in makes."""
    cores = [w.strip(EDGES) for w in words]
    shapes = [shape(c) if c else w[:4] for c, w in zip(cores, words, strict=True)]
    padded = ["<", *shapes, ">"]
    plain = [("a" if s in ("a", "a-a") else s) for s in padded]
    at_sign = [bool(AT.search(w)) or "@" in w for w in words]
    out = []
    for i, s in enumerate(shapes):
        found = [f"s={s}", f"s={s}&p={plain[i]}", f"s={s}&n={plain[i + 2]}", f"at={any(at_sign[max(0, i - 4) : i + 5])}"]
        if any(c.isalpha() for c in cores[i]) and any(c.isdigit() for c in cores[i]):
            found.append("mixed")
        found += [x for x in ("@", "(at)", "[at]", "+", "(", "/", "=") if x in s]
        found.append(f"digits={min(20, sum(c.isdigit() for c in words[i][:64]))}")
        found.append(f"dots={min(4, s.count('.'))}")
        if FOUR.fullmatch(cores[i]):
            found.append(f"ip={all(len(p.lstrip('0')) <= 3 and int(p.lstrip('0') or 0) <= 255 for p in cores[i].split('.'))}")
        if AT.search(words[i]):
            found.append(f"host={bool(HOST.search(' '.join(words[i : i + 4])))}")
        out.append(found)
    i = 0
    while i < len(words):  # runs of numbers: what they make together
        j = i
        while j < len(words) and NUMERIC.fullmatch(cores[j]):
            j += 1
        if j > i:
            run = " ".join(cores[i:j])
            digits = re.sub("[^0-9]", "", run)
            told = [f"run={min(20, len(digits))}", f"area={bool(AREA.match(run)) and len(digits) in (10, 11)}"]
            if 14 <= len(digits) <= 19:
                told.append(f"luhn={luhn(digits)}")
            for k in range(i, j):
                out[k] += told
                own = re.sub("[^0-9]", "", cores[k])
                if 14 <= len(own) <= 19:
                    out[k].append(f"own_luhn={luhn(own)}")
        i = max(j, i + 1)
    return out


class Maker:
    """Personal data, and what only looks like it, made up from letters and digits that are drawn."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def letters(self, least: int, most: int) -> str:
        return "".join(self.draw.choices("abcdefghijklmnopqrstuvwxyz", k=self.draw.randint(least, most)))

    def digits(self, n: int) -> str:
        return "".join(self.draw.choices("0123456789", k=n))

    def parted(self, digits: str, sizes: list[int], gap: str) -> str:
        cuts = np.cumsum([0, *sizes])
        return gap.join(digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def local(self) -> str:
        name = self.letters(1, 9)
        return self.draw.choice([name, name, f"{name}.{self.letters(1, 8)}", f"{name}_{self.letters(1, 5)}", f"{name}{self.digits(2)}", self.letters(30, 300)])

    def host(self) -> str:
        return self.draw.choice([self.letters(2, 10), self.letters(2, 10), f"{self.letters(1, 5)}-{self.letters(1, 5)}", f"{self.letters(2, 5)}{self.digits(1)}", self.letters(30, 300)])

    def email(self) -> str:
        at, dot = self.draw.choice([("(at)", "(dot)"), ("[at]", "[dot]")])
        a, b, c = self.local(), self.host(), self.draw.choice(["com", "org", "net", "de", "io"])
        return self.draw.choice([f"{a}@{b}.{c}", f"{a} {at} {b} {dot} {c}", f"{a} {at} {b}.{c}", f"{a}{at}{b}.{c}", f"{a}{at}{b}{dot}{c}"])

    def ip(self) -> str:
        return ".".join(str(self.draw.randrange(256)) for _ in range(4))

    def card(self) -> str:
        body = self.draw.choice("3456") + self.digits(14)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        return self.draw.choice([number, self.parted(number, [4] * 4, " "), self.parted(number, [4] * 4, "-")])

    def phone(self) -> str:
        a, b, c = self.draw.choice("23456789") + self.digits(2), self.draw.choice("23456789") + self.digits(2), self.digits(4)
        return self.draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+44 {self.digits(2)} {self.digits(4)} {self.digits(4)}", f"+{self.draw.choice(['49', '33'])}{self.digits(9)}"])

    def card_like(self) -> str:
        body = self.digits(15)
        number = next(body + d for d in self.draw.sample("0123456789", 10) if not luhn(body + d))
        return self.draw.choice([number, self.parted(number, [4] * 4, " ")])

    def other(self) -> str:
        """What holds digits or signs of an address, and is no personal data."""
        d, n = self.digits, self.draw.randint
        far = [str(self.draw.randrange(256)) for _ in range(3)] + [str(n(256, 999))]
        self.draw.shuffle(far)
        row = " ".join(d(self.draw.choice([1, 2, 4, 5, 6, 9])) for _ in range(n(2, 12)))
        return self.draw.choice([
            f"{self.letters(3, 8)} = \"{self.letters(1, 3)}{d(2)}{self.letters(1, 3)}{d(3)}\"", f"in {n(1900, 2030)} and", f"page {n(1, 99)} of {n(100, 999)}", f"version {n(0, 9)}.{n(0, 30)}.{n(0, 9)} is", f"costs {n(1, 99)}.{d(2)} now", f"item #{d(3)} |",
            f"at {n(10, 23)}:{n(10, 59)} on 20{d(2)}-0{n(1, 9)}-{n(10, 28)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{n(1, 9)},{d(3)},{d(3)} words", f"the 20{d(2)}/{d(2)} year", f"code {d(5)} holds", f"sum {d(self.draw.choice([11, 12, 13]))} of", f"id=20{d(12)} ok",
            "look at this dot", f"meet @ {self.letters(3, 6)}", f"{n(1, 9)}-{n(10, 99)} days", f"(see {d(2)})", f"{d(2)}-{d(2)}-{d(2)} and", f"{self.card_like()} is", f"{'.'.join(far)} is", f"look (at) {self.letters(3, 6)} word", f"meet [at] {self.letters(3, 6)}", f"call {d(7)} now", f"{d(3)}-{d(2)}-{d(3)} of",
            f"id 20{d(12)} {d(4)}", f"sum {d(self.draw.choice([20, 21, 25]))} is", f"tel {d(10)} or", f"{self.letters(2, 6)}{d(1)} {self.letters(2, 6)}{d(2)}", f"{self.letters(1, 3)}{d(1)}{self.letters(1, 2)}{d(1)} 0x{d(1)}f of", f"no.{d(1)} v{d(1)}.{d(1)} is", f"€{d(2)}.{d(2)} or ${d(1)}", f"{d(2)}% of {d(1)}pm", row, f"{row} and", f"{self.local()}@{self.letters(3, 30)} or",
        ])


def sentence(made: Maker, kinds: list[str | None]) -> tuple[list[str], list[str]]:
    """Words and tags: things of the kinds (None: of no kind) one behind the other, with words around or without."""
    words, tags = [], []
    for k, kind in enumerate(kinds):
        if made.draw.random() < (0.6 if not k else 0.3):
            before = made.draw.choice(["write to", "the word", "|", "from", "at home, call", "see"]).split()
            words, tags = [*words, *before], [*tags, *["O"] * len(before)]
        own = (made.other() if kind is None else getattr(made, kind)()).split()
        words += own
        tags += ["O"] * len(own) if kind is None else [f"{'I' if i else 'B'}-{kind}" for i in range(len(own))]
    if made.draw.random() < 0.6:
        after = made.draw.choice(["or call", "and others.", "|", "is right", "again"]).split()
        words, tags = [*words, *after], [*tags, *["O"] * len(after)]
    return words, tags


def labelled(seed: int = 1, n: int = 900) -> list[tuple[list[str], list[str]]]:
    """The small labelled table, all of it made up: half personal data, half what only looks like it, some side by side."""
    made = Maker(seed)
    ends = [*KINDS, None, None, None]
    return [sentence(made, [made.draw.choice(ends) for _ in range(made.draw.choice([1, 1, 1, 2]))]) for _ in range(n)]


class Field:
    """The fitted field: weights of features for each tag, and of each tag after each."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def potentials(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores, padded to the longest row, and the rows' lengths."""
        n = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), int(n.max()), len(TAGS)))
        for i, row in enumerate(rows):
            for t, found in enumerate(features(row)):
                out[i, t] = self.emit[[k for f in found if (k := self.names.get(f)) is not None]].sum(0)
        return out, n

    def decode(self, rows: list[list[str]]) -> list[list[int]]:
        """Viterbi's best tags of each row, all rows of a batch at once."""
        out: list[list[int]] = [[] for _ in rows]
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        order = [i for i in order if rows[i]]
        k = 0
        while k < len(order):
            n = min(512, len(order) - k)
            while n > 1 and n * len(rows[order[k + n - 1]]) > STEP:
                n //= 2
            part = order[k : k + n]
            k += n
            score, n = self.potentials([rows[i] for i in part])
            best, back = score[:, 0] + self.move[-1], np.zeros(score.shape, np.int64)
            ends = [best]
            for t in range(1, score.shape[1]):
                paths = best[:, :, None] + self.move[:-1][None]
                back[:, t] = paths.argmax(1)
                best = paths.max(1) + score[:, t]
                ends.append(best)
            last = np.stack(ends, 1)[np.arange(len(part)), n - 1].argmax(1)
            for j, i in enumerate(part):
                tags, tag = [], int(last[j])
                for t in range(n[j] - 1, -1, -1):
                    tags.append(tag)
                    tag = int(back[j, t, tag])
                out[i] = tags[::-1]
        return out


def train(rows: list[tuple[list[str], list[str]]], steps: int = 150) -> Field:
    """Maximum likelihood with forward-backward sums in numpy, Adam steps and a little L2. No randomness."""
    found = [features(words) for words, _ in rows]
    names: dict[str, int] = {}
    for row in found:
        for word in row:
            for f in word:
                names.setdefault(f, len(names))
    k, n, longest = len(TAGS), np.array([len(r) for r in found]), max(len(r) for r in found)
    at = [(i, t, names[f]) for i, row in enumerate(found) for t, word in enumerate(row) for f in word]
    seq, place, feature = (np.array(x) for x in zip(*at, strict=True))
    gold = np.zeros((len(rows), longest), np.int64)
    for i, (_, tags) in enumerate(rows):
        gold[i, : len(tags)] = [TAGS.index(t) for t in tags]
    inside = np.arange(longest) < n[:, None]
    emit, move = np.zeros((len(names), k)), np.zeros((k + 1, k))
    for a, tag in enumerate(TAGS):  # an I goes on from a B or I of its kind alone
        for b, nxt in enumerate(TAGS):
            if nxt[0] == "I" and tag[1:] != nxt[1:]:
                move[a, b] = -50
    move[k, [b for b, t in enumerate(TAGS) if t[0] == "I"]] = -50
    fixed = move < -1
    state = [np.zeros_like(emit), np.zeros_like(move), np.zeros_like(emit), np.zeros_like(move)]
    every = np.arange(len(rows))
    for step in range(1, steps + 1):
        score = np.zeros((len(rows), longest, k))
        np.add.at(score, (seq, place), emit[feature])
        soft = lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
        fore, back = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0] + move[-1]
        for t in range(1, longest):
            fore[:, t] = np.where(inside[:, t, None], soft(fore[:, t - 1][:, :, None] + move[:-1], 1) + score[:, t], fore[:, t - 1])
        whole = soft(fore[:, -1], 1)
        grad_move = np.zeros_like(move)
        for t in range(longest - 2, -1, -1):
            after = score[:, t + 1] + back[:, t + 1]
            back[:, t] = np.where(inside[:, t + 1, None], soft(move[:-1][None] + after[:, None, :], 2), 0)
            pair = np.exp(fore[:, t][:, :, None] + move[:-1] + after[:, None, :] - whole[:, None, None]) * inside[:, t + 1, None, None]
            grad_move[:-1] += pair.sum(0)
            np.add.at(grad_move, (gold[inside[:, t + 1], t], gold[inside[:, t + 1], t + 1]), -1)
        chance = np.exp(fore + back - whole[:, None, None]) * inside[:, :, None]
        grad_move[-1] += chance[:, 0].sum(0)
        np.add.at(grad_move, (np.full(len(rows), k), gold[:, 0]), -1)
        chance[every[:, None], np.arange(longest), gold] -= inside
        grad_emit = np.zeros_like(emit)
        np.add.at(grad_emit, feature, chance[seq, place])
        grads = [grad_emit + 0.01 * emit, np.where(fixed, 0, grad_move + 0.01 * move)]
        for j, (w, g) in enumerate(zip((emit, move), grads, strict=True)):
            state[j] = 0.9 * state[j] + 0.1 * g
            state[2 + j] = 0.99 * state[2 + j] + 0.01 * g**2
            w -= 0.1 * (state[j] / (1 - 0.9**step)) / (np.sqrt(state[2 + j] / (1 - 0.99**step)) + 1e-8)
    return Field(names, emit, move)


_field: list[Field] = []


def field() -> Field:
    """The field that is trained on `labelled`; the same weights in every process."""
    if not _field:
        _field.append(train(labelled()))
    return _field[0]


def some_words(text: str, lo: int, hi: int, last: bool) -> list[re.Match]:
    """The first, or last, GAP words of text[lo:hi], however long they are; both ends are ends of words or blanks."""
    size = 64
    while True:
        a, b = (max(lo, hi - size), hi) if last else (lo, min(hi, lo + size))
        found = list(WORD.finditer(text, a, b))
        if len(found) > GAP or b - a == hi - lo:  # one more than GAP: so these aren't cut
            return found[-GAP:] if last else found[:GAP]
        size *= 4


def windows(text: str) -> list[list[tuple[int, int]]]:
    """The words around those that may be in a span, as spans of words."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    if TRIGGER.search(text):
        text = LONG.sub(lambda m: SPLIT.sub(" ", m[0]), text)
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        left = text[max(done, m.start() - 65) : m.start()]
        if len(left) == 65 and len(left.split()) == 1:
            left = text[done : m.start()]
        begin = m.start() - (len(left.split()[-1]) if left and not left[-1].isspace() else 0)
        done = TAIL.match(text, m.end()).end()
        while out and out[-1] and out[-1][-1][0] >= begin:  # the word that the window before ends in
            out[-1].pop()
        if out and not out[-1]:
            out.pop()
        behind = out[-1][-1][1] if out else 0
        before = some_words(text, behind, begin, True)
        if not out or WORD.search(text, behind, before[0].start() if before else behind):
            out.append([])
        out[-1] += [x.span() for x in before]
        out[-1] += [x.span() for x in WORD.finditer(text, begin, done)]
        out[-1] += [x.span() for x in some_words(text, done, len(text), False)]
    return out


def spans(texts: list[str], trained: Field | None = None) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, whether a pattern found it) of each text, in order."""
    base = [base_spans(t) for t in texts]
    cut = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    tagged = (trained or field()).decode([[texts[i][a:b] for a, b in w] for i, w in cut])
    out = [[(a, k, b, True) for a, k, b in found] for found in base]
    for (i, w), tags in zip(cut, tagged, strict=True):
        held: list[list[int]] = []
        for (a, b), tag in zip(w, tags, strict=True):
            if tag and TAGS[tag][0] == "I" and held and texts[i][held[-1][2] : a].isspace():
                held[-1][2] = b
            elif tag:
                held.append([a, KINDS.index(TAGS[tag][2:]), b])
        for a, k, b in held:
            while b > a and texts[i][b - 1] in EDGES:
                b -= 1
            if b > a and not any(a < y and x < b for x, _, y, _ in out[i]):
                out[i].append((a, k, b, False))
    return [sorted(x) for x in out]


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of the whole text of every row; map-only. The driver trains the field."""
    trained = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for part in slices(batches):
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in x] for x in spans([t or "" for t in part.column("text").to_pylist()], trained)]
            yield pa.record_batch([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def mask(text: str, trained: Field | None = None) -> str:
    """The text with every span replaced by its kind in angle brackets; of spans that touch the first one counts."""
    out, at = [], 0
    for a, k, b, _ in spans([text], trained)[0]:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns with every span masked in `text`; nulls and rows without spans stay as they are."""
    at, trained = docs.columns.index(text), field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            masked = pa.array([t and mask(t, trained) for t in part.column(at).to_pylist()], part.schema.field(at).type)
            yield pa.record_batch([masked if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return map_rows(docs, run)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir)).withColumn("own", F.filter("spans", lambda x: x["base"]))
    counts = [F.size(F.expr(f"filter(own, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("own")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
