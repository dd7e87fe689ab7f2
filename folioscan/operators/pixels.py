"""Image files as pixels: PNG and BMP files decoded, resampled, and cut into flattened patches of one shape."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of patches that a batch holds.
BATCH = 2_000_000


class NoImage(ValueError):
    pass


def decode(content: bytes) -> np.ndarray:
    """Height x width x 3 bytes of a PNG or BMP file; alpha is left out, grey becomes three equal channels."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] == b"BM":
        return _bmp(content)
    raise NoImage("neither PNG nor BMP")


def size_of(content: bytes) -> tuple[int, int]:
    """Height and width by the file's header alone."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">I", content[20:24])[0], struct.unpack(">I", content[16:20])[0]
    if content[:2] == b"BM" and len(content) >= 26:
        return abs(struct.unpack("<i", content[22:26])[0]), struct.unpack("<i", content[18:22])[0]
    raise NoImage("neither PNG nor BMP")


def _png(content: bytes) -> np.ndarray:
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", content[at + 8 + size : at + 12 + size].rjust(4, b"\0"))[0] != zlib.crc32(kind + body):
            raise NoImage(f"a broken chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise NoImage("no header")
    width, height, bits, kind, _, _, woven = head
    if woven or kind not in (0, 2, 3, 4, 6) or not width or not height:
        raise NoImage(f"no such form here: colour {kind}, interlaced {woven}")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    row, step = (width * channels * bits + 7) // 8, max(1, channels * bits // 8)
    data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(data) < height * (row + 1):
        raise NoImage("rows are missing")
    data = data[: height * (row + 1)].reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(data[y, 1:], int(data[y, 0]), above, step)
    if bits == 16:
        out = out[:, ::2]  # the high bytes
    elif bits < 8:
        out = np.unpackbits(out, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
        out = out[:, : width * channels]
        if kind == 0:
            out = (out * (255 // ((1 << bits) - 1))).astype(np.uint8)
    pixels = out.reshape(height, width, channels)
    if kind == 3:
        if palette is None or int(pixels.max()) >= len(palette):
            raise NoImage("a colour that the palette lacks")
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3] if kind in (2, 6) else np.repeat(pixels[:, :, :1], 3, 2)


def _unfiltered(row: np.ndarray, kind: int, above: np.ndarray, step: int) -> np.ndarray:
    """A row of a PNG file as it was before it was written as differences."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        padded = np.zeros(-(-len(row) // step) * step, np.uint8)
        padded[: len(row)] = row
        return np.cumsum(padded.reshape(-1, step), 0, np.uint8).ravel()[: len(row)]
    if kind not in (3, 4):
        raise NoImage(f"no such filter: {kind}")
    out, up = bytearray(row.tobytes()), above.tobytes()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            out[i] = (out[i] + (left + up[i]) // 2) & 255
            continue
        a, b, c = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
        out[i] = (out[i] + (left if a <= b and a <= c else up[i] if b <= c else corner)) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _bmp(content: bytes) -> np.ndarray:
    if len(content) < 54:
        raise NoImage("no header")
    start, head, width, height = struct.unpack("<IIii", content[10:26])
    bits, packing = struct.unpack("<HI", content[28:34])
    used = struct.unpack("<I", content[46:50])[0]
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or not height:
        raise NoImage(f"no such form here: {bits} bits, packing {packing}")
    row = (width * bits + 31) // 32 * 4
    data = np.frombuffer(content[start : start + row * abs(height)], np.uint8)
    if len(data) < row * abs(height):
        raise NoImage("rows are missing")
    rows = data.reshape(abs(height), row)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if height > 0:  # rows from the bottom up
        rows = rows[::-1]
    if bits == 8:
        palette = np.frombuffer(content[14 + head : 14 + head + 4 * (used or 256)], np.uint8).reshape(-1, 4)
        if int(rows.max()) >= len(palette):
            raise NoImage("a colour that the palette lacks")
        rows = palette[rows[:, :, 0]]
    return rows[:, :, 2::-1]


def weights(old: int, new: int) -> np.ndarray:
    """new x old: how much of each old pixel is in each new one; a triangle as wide as the scale, at least one pixel."""
    scale = old / new
    centre = (np.arange(new) + 0.5) * scale
    held = np.maximum(0.0, 1 - np.abs(np.arange(old) + 0.5 - centre[:, None]) / max(scale, 1.0))
    return (held / held.sum(1, keepdims=True)).astype(np.float32)


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image resampled, first across, then down."""
    across = np.einsum("yxc,ox->yoc", pixels.astype(np.float32), weights(pixels.shape[1], width), optimize=True)
    return np.einsum("yxc,oy->oxc", across, weights(pixels.shape[0], height), optimize=True)


def normalised(pixels: np.ndarray) -> np.ndarray:
    """The image less its mean, over its deviation, which counts as one over the root of its numbers at least."""
    x = pixels.astype(np.float32)
    return (x - x.mean()) / max(float(x.std()), 1 / math.sqrt(x.size))


def grid(height: int, width: int, most: int, side: int) -> tuple[int, int]:
    """Rows and columns of the patches, of which `most` hold the image at its proportions."""
    scale = math.sqrt(most * (side / height) * (side / width))
    return tuple(max(min(math.floor(scale * n / side), most), 1) for n in (height, width))


def patches(pixels: np.ndarray, most: int, side: int, offset: int = 0) -> np.ndarray:
    """A row for each patch: its row (from 1, after `offset`), its column (from 1), and its pixels' channels."""
    rows, columns = grid(*pixels.shape[:2], most, side)
    image = resized(pixels, rows * side, columns * side)
    cut = image.reshape(rows, side, columns, side, -1).transpose(0, 2, 1, 3, 4).reshape(rows * columns, -1)
    at = np.stack([np.repeat(np.arange(rows) + 1 + offset, columns), np.tile(np.arange(columns) + 1, rows)], 1)
    return np.concatenate([at.astype(np.float32), cut], 1)[:most]


def image_sizes(images: DataFrame) -> DataFrame:
    """The columns of images with height and width in the place of content; null for what isn't an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for content in batch.column("content").to_pylist():
                try:
                    told.append(size_of(content or b""))
                except NoImage:
                    told.append((None, None))
            kept = batch.drop_columns(["content"])
            yield pa.record_batch([*kept.columns, *(pa.array(x, pa.int32()) for x in zip(*told, strict=True))], [*kept.schema.names, "height", "width"])

    names = [f for f in images.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", height int, width int"
    return images.mapInArrow(run, schema)


def image_patches(images: DataFrame, most: int, side: int = 16, normal: bool = False, share: str | None = None, offset: str | None = None) -> DataFrame:
    """The columns of images without content, and height, width, rows, columns, patches, error.

    patches is a tensor of one shape: `most` patches (those behind the image's own are zeros) of 2 + side * side * 3 numbers.
    `share` and `offset` name columns with an image's own most and the rows of images before it; then only its own patches are
    given. What isn't an image has a message in `error` and nothing else. Images are read one at a time.
    """
    names = [f for f in images.schema.fields if f.name != "content"]
    numbers = 2 + side * side * 3
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", height int, width int, rows int, columns int, patches array<array<float>>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, told, first, held = batch.drop_columns(["content"]), [], 0, 0

            def made(first: int, told: list, kept: pa.RecordBatch = kept) -> pa.RecordBatch:
                flat = np.concatenate([x[4].ravel() for x in told if x[4] is not None] or [np.zeros(0, np.float32)])
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, numbers), pa.int32()), pa.array(flat, pa.float32()))
                ends = np.cumsum([0] + [0 if x[4] is None else len(x[4]) for x in told])
                outer = pa.ListArray.from_arrays(pa.array([None if x[4] is None else int(e) for x, e in zip(told, ends, strict=False)] + [int(ends[-1])], pa.int32()), inner)
                plain = [pa.array([x[k] for x in told], pa.int32()) for k in range(4)]
                return pa.record_batch([*kept.slice(first, len(told)).columns, *plain, outer, pa.array([x[5] for x in told], pa.string())], [*kept.schema.names, "height", "width", "rows", "columns", "patches", "error"])

            own = batch.column(share).to_pylist() if share else [most] * batch.num_rows
            before = batch.column(offset).to_pylist() if offset else [0] * batch.num_rows
            for i, content in enumerate(batch.column("content")):
                try:
                    pixels = decode(content.as_py() or b"")
                    found = patches(normalised(pixels) if normal else pixels, own[i], side, before[i])
                    if not share and len(found) < most:
                        found = np.concatenate([found, np.zeros((most - len(found), numbers), np.float32)])
                    told.append((*pixels.shape[:2], *grid(*pixels.shape[:2], own[i], side), found, None))
                    held += found.size
                except (NoImage, zlib.error, struct.error) as e:
                    told.append((None,) * 5 + (str(e),))
                if held > BATCH:
                    yield made(first, told)
                    first, told, held = i + 1, [], 0
            if told:
                yield made(first, told)

    return images.mapInArrow(run, schema)


def document_patches(pages: DataFrame, most: int, side: int = 16, normal: bool = False) -> DataFrame:
    """document, page, patches of every page (document, page, content): the pages of a document share `most` equally, and
    their rows are numbered on from page to page. A page that isn't an image has none."""
    sizes = image_sizes(pages.select("document", "page", "content")).filter("height IS NOT NULL")
    by = Window.partitionBy("document")
    shared = sizes.withColumn("share", F.floor(F.lit(most) / F.count("*").over(by)).cast("int")).filter("share > 0")
    scale = F.sqrt(F.col("share") * (F.lit(side) / F.col("height")) * (F.lit(side) / F.col("width")))
    rows = F.greatest(F.least(F.floor(scale * F.col("height") / side), F.col("share")), F.lit(1))
    before = F.coalesce(F.sum(rows).over(by.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = shared.withColumn("before", before).select("document", "page", "share", "before")
    held = pages.select("document", "page", "content").join(placed, ["document", "page"])
    return image_patches(held, most, side, normal, "share", "before").filter("error IS NULL").select("document", "page", "patches")
