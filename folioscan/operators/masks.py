"""Masks as columns: regions of touching pixels, found by runs of pixels and their links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Masks that a task reads, and regions that it tells, at a time.
MASKS, REGIONS = 64, 20_000


def regions(mask: np.ndarray, least: int = 4) -> np.ndarray:
    """x0, y0, x1, y1, n of each region of touching true pixels (corners touch too) of at least `least` pixels, from the top.

    Each row's runs of true pixels are the nodes, and runs of the next row that touch one are its links; labels sink to the
    least run that links reach.
    """
    height, width = mask.shape
    edges = np.diff(np.pad(mask.astype(bool), ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    # Places of runs in one order over all rows; rows are too far apart to touch by it.
    below = (y + 1) * (width + 2)
    first = np.searchsorted(y * (width + 2) + end, below + start)
    n = np.maximum(np.searchsorted(y * (width + 2) + start, below + end, side="right") - first, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)
    label = np.arange(len(y))
    while len(a):
        a, b = label[a], label[b]
        live = a != b
        a, b = a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    names, of = np.unique(label, return_inverse=True)
    out = np.zeros((len(names), 5), np.int64)
    out[:, :2] = max(width, height)
    for column, values, keep in ((0, start, np.minimum), (1, y, np.minimum), (2, end, np.maximum), (3, y + 1, np.maximum), (4, end - start, np.add)):
        keep.at(out[:, column], of, values)
    return out[out[:, 4] >= least]


def mask_regions(masks: DataFrame, key: str, least: int = 4) -> DataFrame:
    """key, region, x0, y0, x1, y1, n of the regions of each mask (key, width, mask: a byte for each pixel, row by row); a row
    that the mask doesn't fill is false behind its end. Null and empty masks have no regions."""

    def told(batch: pa.RecordBatch, at: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        return pa.record_batch([batch.column(key).take(pa.array(np.concatenate(at))), *(pa.array(c) for c in rows.T.copy())], [key, "region", "x0", "y0", "x1", "y1", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, n = [], [], 0
            for first in range(0, batch.num_rows, MASKS):
                some = batch.slice(first, MASKS)
                for i, (width, mask) in enumerate(zip(some.column("width").to_pylist(), some.column("mask").to_pylist(), strict=True), first):
                    flat = np.frombuffer(mask or b"", np.uint8)
                    if not width or not len(flat):
                        continue
                    grid = np.zeros(-(-len(flat) // width) * width, bool)
                    grid[: len(flat)] = flat > 0
                    own = regions(grid.reshape(-1, width), least)
                    at.append(np.full(len(own), i))
                    found.append(np.concatenate([np.arange(len(own))[:, None], own], 1))
                    n += len(own)
                    if n >= REGIONS:
                        yield told(batch, at, found)
                        at, found, n = [], [], 0
            if n:
                yield told(batch, at, found)

    kind = masks.schema[key].dataType.simpleString()
    return masks.select(key, "width", "mask").mapInArrow(run, f"`{key}` {kind}, region long, x0 long, y0 long, x1 long, y1 long, n long")
