"""Regions of masks against a flood fill."""

import numpy as np

from folioscan.operators import masks as K


def flooded(mask, least):
    held, out = np.zeros(mask.shape, bool), []
    for y, x in np.argwhere(mask):
        if held[y, x]:
            continue
        held[y, x], stack, seen = True, [(y, x)], []
        while stack:
            a, b = stack.pop()
            seen.append((a, b))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not held[c, d]:
                        held[c, d] = True
                        stack.append((c, d))
        if len(seen) >= least:
            ys, xs = zip(*seen, strict=True)
            out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(seen)))
    return out


def snake(n):
    """One winding region, the worst case for links."""
    m = np.zeros((n, n), bool)
    m[::2] = True
    m[1::4, -1] = m[3::4, 0] = True
    return m


def test_regions():
    rng = np.random.default_rng(1)
    cases = [rng.random((h, w)) < p for h, w in ((1, 1), (1, 9), (9, 1), (13, 17), (40, 31)) for p in (0.1, 0.4, 0.6, 1.0)]
    for mask in [*cases, snake(21), np.zeros((0, 4), bool), np.zeros((3, 3), bool), np.eye(6, dtype=bool)]:
        for least in (1, 4):
            assert list(map(tuple, K.regions(mask, least).tolist())) == flooded(mask, least)


def test_mask_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, w, bytes((rng.random(n) < 0.5).astype(np.uint8))) for i, (w, n) in enumerate([(5, 23), (7, 49), (1, 3), (9, 0)])] + [(9, 4, None), (None, 3, b"\x01" * 9)]
    got = {}
    for r in K.mask_regions(spark.createDataFrame(rows, "page long, width int, mask binary"), "page", 2).collect():
        got.setdefault(r["page"], []).append(tuple(r)[2:])
    for page, width, mask in rows:
        flat = np.frombuffer((mask or b"") + bytes(-len(mask or b"") % width), np.uint8).reshape(-1, width) > 0
        assert got.get(page, []) == flooded(flat, 2)


def test_query(spark, tmp_path):
    from folioscan import catalog

    pages = [(1, "u", "AB c\nD3 ef" * 30 + "<p>XYZ</p>é"), (2, "u", None), (3, "u", ""), (4, "u", "lower case only\t\n")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {}
    for r in catalog.queries()["mask_regions"](spark, str(tmp_path)).orderBy("page_id", "region").collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[2:])
    for page, _, html in pages:
        seen = [c not in b"abcdefghijklmnopqrstuvwxyz \t\n" for c in (html or "").encode()]
        flat = np.array(seen + [False] * (-len(seen) % 40), bool).reshape(-1, 40)
        assert got.get(page, []) == flooded(flat, 4)


def test_regions_are_told_some_at_a_time(spark, monkeypatch):
    """Masks are read and regions told in parts; none is lost or numbered anew where a part ends."""
    monkeypatch.setattr(K, "MASKS", 3)
    monkeypatch.setattr(K, "REGIONS", 5)
    line = lambda n: b"\1\1\0" * n
    rows = [(i, 3 * i if i else None, line(i) if i % 4 else b"") for i in range(40)]
    found = K.mask_regions(spark.createDataFrame(rows, "page long, width int, mask binary").coalesce(1), "page", 2).collect()
    assert sorted((r.page, r.region, r.x0, r.x1) for r in found) == [(i, k, 3 * k, 3 * k + 2) for i in range(40) if i % 4 for k in range(i)]
