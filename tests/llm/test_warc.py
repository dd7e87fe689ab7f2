"""Archives written and read back: against plain loops, with magic, records and whole archives inside payloads."""

import hashlib
import random

import pytest

from folioscan.llm import warc


def plain_records(data):
    """type, id and block of every record, from the first byte on."""
    at = 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        body, n = at + len(head) + 4, int(lines["Content-Length"])
        yield at, lines["WARC-Type"], lines["WARC-Record-ID"], data[body : body + n]
        at = body + n + 4


def made(kind, name, block, http=False):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nContent-Length: {len(block)}\r\n"
    return head.encode() + (b"Content-Type: application/http\r\n" if http else b"") + b"\r\n" + block + b"\r\n\r\n"


def want(rows):
    groups = {}
    for page, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        most = max((p for p in groups[html or ""] if p is not None), default=None)
        again = len(data) >= 1000 and most is not None and page != most
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", most if again else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [16 << 20, 1500])
def test_warc(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "RANGE", size)
    monkeypatch.setattr(warc, "TASKS", 6)
    nested = (made("response", "<urn:x-page:1>", b"inner") * 3).decode()
    bad = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\nrest WARC/1.1\r\nnot a field\r\n"
    pages = [None, "", "<p>short</p>", "WARC/1.1\r\n", nested, nested * 20, bad * 3, "ä" * 499, "ä" * 500, "x" * 999, "x" * 1000, "end\r\n\r\n" * 300, "\x00\x7f" * 600]
    rows = [(i, f"http://host/{i}" if i % 3 else None, html, "x") for i, html in enumerate(pages * 3)]
    rows += [(5, "a\r\nWARC-Type: evil", "x" * 1000, "x"), (38, "http://host/again", pages[12], "x"), (None, None, "x" * 1000, "y"), (None, "u", None, "y"), (-4, "u", "y" * 2000, "y"), (None, "u", "y" * 2000, "y")]
    rows.append((50, "u", "long " * 100_000 + nested, "x"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, `URL` string").repartition(3)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs.write.parquet(str(tmp_path / "pages.parquet"))
        got = warc.op12_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert sorted(map(tuple, got), key=str) == want(rows)


def test_warc_without_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op12_warc(spark, str(tmp_path)).collect() == []


def test_groups_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SENT_GROUPS", 0)
    rows = [(i, "u", "z" * (1000 + i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, warc.op12_warc(spark, str(tmp_path)).collect()), key=str) == want(rows)


@pytest.mark.parametrize("size", [64, 333, 5000, 1 << 20])
def test_other_archives(spark, tmp_path, monkeypatch, size):
    """Binary payloads, archives in payloads that begin anywhere, against a walk from the first byte; a broken file ends early."""
    monkeypatch.setattr(warc, "RANGE", size)
    monkeypatch.setattr(warc, "TASKS", 6)
    rng = random.Random(size)
    inner = b"".join(made("resource", f"<in:{i}>", rng.randbytes(rng.randrange(40))) for i in range(30))
    files = []
    for f in range(3):
        parts = [made(rng.choice(["resource", "metadata"]), f"<{f}:{i}>", rng.choice([b"", rng.randbytes(rng.randrange(3000)), inner, inner[5:], b"WARC/1.0\r\n" * 9, b"\xff" + inner + b"\r\n\r\n"])) for i in range(40)]
        files.append(b"".join(parts))
    broken = files[0][: len(files[0]) // 2] + b"??" + files[0][len(files[0]) // 2 :]
    (tmp_path / "w").mkdir()
    for i, data in enumerate([*files, broken]):
        (tmp_path / "w" / f"{i}.warc").write_bytes(data)
    got = {}
    for r in warc.read(spark, str(tmp_path / "w")).collect():
        got.setdefault(r["file"][-6], []).append((r["offset"], r["type"], r["record_id"], bytes(r["payload"])))
    whole = {c["file"][-6]: c for c in warc.chains(spark, str(tmp_path / "w")).collect()}
    for i, data in enumerate(files):
        assert sorted(got[str(i)]) == list(plain_records(data))
        assert whole[str(i)]["end"] == whole[str(i)]["size"] == len(data) and whole[str(i)]["n"] == 40
    assert whole["3"]["end"] < whole["3"]["size"] and 0 < whole["3"]["n"] < 40
    assert sorted(got["3"])[: whole["3"]["n"] - 1] == list(plain_records(files[0]))[: whole["3"]["n"] - 1]
