"""Image files made here, decoded; resampling and patches against double loops."""

import math
import struct
import zlib

import numpy as np
import pytest

from folioscan.operators import pixels as P


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows, width, bits, kind, step, filters, palette=None):
    """A file of packed rows, each written by one of the filters."""
    out, above = b"", bytes(len(rows[0]))
    for row, f in zip(rows, filters, strict=True):
        line = bytearray()
        for i, v in enumerate(row):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = left + up - corner
            near = sorted([(abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)])[0][2]
            line.append((v - [0, left, up, (left + up) // 2, near][f]) & 255)
        out += bytes([f]) + line
        above = row
    data = zlib.compress(out)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), bits, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


def bmp(pixels, bits, down=False):
    h, w, _ = pixels.shape
    rows = pixels[:, :, ::-1] if bits == 24 else np.concatenate([pixels[:, :, ::-1], np.full((h, w, 1), 9, np.uint8)], 2)
    lines = [r.tobytes() + bytes(-len(r.tobytes()) % 4) for r in (rows if down else rows[::-1])]
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, 0, 0, 0, 0, 0) + b"".join(lines)


def image(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def test_kinds_of_files():
    x, filters = image(7, 5), [0, 1, 2, 3, 4, 4, 3]
    packed = lambda a: [r.tobytes() for r in a]
    rgb, grey = png(packed(x), 5, 8, 2, 3, filters), x[:, :, :1]
    same = np.repeat(grey, 3, 2)
    assert (P.decode(rgb) == x).all() and P.size_of(rgb) == (7, 5)
    assert (P.decode(png(packed(np.concatenate([x, grey], 2)), 5, 8, 6, 4, filters)) == x).all()
    assert (P.decode(png(packed(grey), 5, 8, 0, 1, filters)) == same).all()
    assert (P.decode(png(packed(np.concatenate([grey, grey], 2)), 5, 8, 4, 2, filters)) == same).all()
    assert (P.decode(png(packed(np.stack([x, 255 - x], 3)), 5, 16, 2, 6, filters)) == x).all()
    for bits in (1, 2, 4, 8):
        index = (grey[:, :, 0].astype(int) % (1 << bits)).astype(np.uint8)
        lines = [np.packbits(np.unpackbits(r[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes() for r in index]
        palette = image(1, 1 << bits, 3)[0]
        assert (P.decode(png(lines, 5, bits, 3, 1, filters, palette.tobytes())) == palette[index]).all()
        assert (P.decode(png(lines, 5, bits, 0, 1, filters))[:, :, 0] == index * (255 // ((1 << bits) - 1))).all()
    for bits in (24, 32):
        for down in (False, True):
            assert (P.decode(bmp(x, bits, down)) == x).all() and P.size_of(bmp(x, bits, down)) == (7, 5)
    for broken in (b"", b"GIF89a", rgb[:40], rgb[:-30], rgb[:60] + bytes([rgb[60] ^ 1]) + rgb[61:], bmp(x, 24)[:-5]):
        with pytest.raises((P.NoImage, zlib.error)):
            P.decode(broken)


def plain_patches(x, most, side, offset):
    h, w, _ = x.shape
    scale = math.sqrt(most * (side / h) * (side / w))
    rows, columns = (max(min(math.floor(scale * n / side), most), 1) for n in (h, w))

    def along(line, new):
        out = []
        for i in range(new):
            s = len(line) / new
            held = [max(0.0, 1 - abs(j + 0.5 - (i + 0.5) * s) / max(s, 1)) for j in range(len(line))]
            out.append(sum(a * b for a, b in zip(held, line, strict=True)) / sum(held))
        return out

    planes = []
    for c in range(3):
        across = [along(list(map(float, line)), columns * side) for line in x[:, :, c]]
        planes.append([along(list(column), rows * side) for column in zip(*across, strict=True)])  # by column
    cuts = [(r, k) for r in range(rows) for k in range(columns)]
    return [[r + 1 + offset, k + 1, *(planes[c][k * side + j][r * side + i] for i in range(side) for j in range(side) for c in range(3))] for r, k in cuts][:most]


def test_patches(spark):
    for h, w, most, side, offset in ((13, 9, 12, 2, 0), (3, 40, 7, 3, 2), (30, 4, 5, 4, 1), (8, 8, 1, 5, 0), (1, 1, 4, 2, 3)):
        x = image(h, w, h)
        assert np.abs(P.patches(x, most, side, offset) - np.array(plain_patches(x, most, side, offset))).max() < 0.01
    files = [("a", bmp(image(13, 9), 24)), ("b", b"no image"), ("c", None), ("d", bmp(image(5, 30, 2), 32))]
    frame = spark.createDataFrame(files, "name string, content binary")
    rows = {r["name"]: r for r in P.image_patches(frame, 12, 2).collect()}
    assert rows["b"]["error"] and rows["c"]["error"] and rows["b"]["patches"] is None
    for name, x in (("a", image(13, 9)), ("d", image(5, 30, 2))):
        want, r = plain_patches(x, 12, 2, 0), rows[name]
        held = np.array(r["patches"])
        assert (r["height"], r["width"]) == x.shape[:2] and r["rows"] * r["columns"] == len(want) and held.shape == (12, 14)
        assert np.abs(held[: len(want)] - want).max() < 0.01 and not held[len(want) :].any()
    one = P.image_patches(frame.filter("name = 'a'"), 12, 2, normal=True).first()
    x = image(13, 9).astype(float)
    assert np.abs(np.array(one["patches"])[0, 2:] - plain_patches((x - x.mean()) / x.std(), 12, 2, 0)[0][2:]).max() < 0.01


def test_patches_of_documents(spark):
    pages = [(d, p, bmp(image(5 + 3 * p, 9 + d, p), 24)) for d in range(3) for p in range(d + 1)] + [(2, 7, b"none")]
    frame = spark.createDataFrame(pages, "document long, page long, content binary")
    got = {(r["document"], r["page"]): np.array(r["patches"]) for r in P.document_patches(frame, 16, 2).collect()}
    assert len(got) == 6
    for d in range(3):
        offset = 0
        for p in range(d + 1):
            want = np.array(plain_patches(image(5 + 3 * p, 9 + d, p), 16 // (d + 1), 2, offset))
            assert np.abs(got[d, p] - want).max() < 0.01
            offset = int(want[:, 0].max())


def test_query(spark, tmp_path):
    from folioscan import catalog

    pages = [(1, "u", "<html>some text</html>" * 60), (2, "u", None), (3, "u", "é" * 500)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in catalog.queries()["image_patches"](spark, str(tmp_path)).collect()}
    for page, _, html in pages:
        data = (html or "").encode() or bytes(96)
        x = np.frombuffer(data + bytes(-len(data) % 96), np.uint8).reshape(-1, 32, 3)[:, :, ::-1].astype(float)
        x = (x - x.mean()) / max(x.std(), 1 / math.sqrt(x.size))
        want = np.array(plain_patches(x, 64, 8, 0))
        r = got[page]
        assert (r["height"], r["width"], r["n"], r["rows"] * r["columns"]) == (*x.shape[:2], 64, len(want))
        assert abs(r["total"] - np.abs(want[:, 2:]).sum()) < 0.05
