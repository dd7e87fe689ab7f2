"""Bounds that hold whatever a text holds: the token counter's states, and spans of any length among personal data."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioscan.llm import pii, token_count


def test_states_are_dropped_within_a_text(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_count.load(path)
    monkeypatch.setattr(token_count, "STATES", 300)
    monkeypatch.setattr(token_count, "LANES", 7)
    most, add = [0], token_count.PieceCounter.add
    monkeypatch.setattr(token_count.PieceCounter, "add", lambda self, key: (add(self, key), most.append(max(most.pop(), len(self.states))))[0])
    rng = random.Random(2)
    letters = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEÉ": "".join(rng.choice(a) for _ in range(n))
    texts = [letters(30_000), " ".join(letters(rng.randrange(1, 12)) for _ in range(3000)), letters(5000) + " " + letters(4000) + " " + letters(6000), "日本語" * 2000, "\n " * 500]
    counter.pieces.reset()
    got = counter.count(texts)[1].tolist()
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert most[0] <= 300 + 7 * 2 + 2
    counter.pieces.reset()


@pytest.mark.parametrize("n", [1, 40, 64, 65, 500, 5000])
@pytest.mark.parametrize("form", ["{0} (at) {1} (dot) org", "{0} [at] {1} [dot] org", "{0}(at){1}.org", "{0}(at){1}(dot)org", "{0} (at) {1}.org"])
def test_addresses_of_any_length(n, form):
    for local, host in (("ann", "h" * n), ("a" * n, "host")):
        assert pii.mask(f"mail {form.format(local, host)} now") == "mail <email> now"
    assert pii.mask(f"ann@{'h' * n} (212) 555-0147").endswith(" <phone>")


def test_the_field_on_made_up_data_that_it_was_not_trained_on():
    def spans_of(tags):
        out, open_ = set(), None
        for i, t in enumerate([*tags, "O"]):
            if open_ and not (t[0] == "I" and t[2:] == open_[1]):
                out.add((*open_, i))
                open_ = None
            if t[0] == "B":
                open_ = (i, t[2:])
        return out

    rows = pii.labelled(99, 1000)
    found = pii.field().decode([w for w, _ in rows])
    want, got = ({(k, *x) for k, tags in enumerate(y) for x in spans_of(tags)} for y in ([t for _, t in rows], [[pii.TAGS[x] for x in t] for t in found]))
    assert len(want & got) / len(got) > 0.97 and len(want & got) / len(want) > 0.95


def test_windows_hold_the_words_around_every_trigger():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(["a", "bc", "9", "x@", "(at)", "d" * rng.choice([3, 60, 64]), "e" * 70, "[at]f"]) for _ in range(rng.randrange(25))]
        text = "".join(w + rng.choice([" ", "\n", "  "]) for w in words)
        spans = [m.span() for m in pii.WORD.finditer(text)]
        hot = [i for i, (a, b) in enumerate(spans) if pii.TRIGGER.search(text[a:b])]
        want = sorted({k for i in hot for k in range(max(0, i - pii.GAP), min(len(spans), i + pii.GAP + 1))})
        got = [w for x in pii.windows(text) for w in x]
        assert got == [spans[k] for k in want]
        assert all(a[-1][1] <= b[0][0] for a, b in zip(pii.windows(text), pii.windows(text)[1:], strict=False))
