"""Groups of a page's layout boxes by place and meaning, and what is made of the groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Boxes beyond which a page's affinity isn't held whole, its rows that are then held, and spaces that its spectrum is sought in.
WHOLE, ROWS, SPACES = 1_500, 256, 40


def affinity(boxes: np.ndarray, vectors: np.ndarray | None = None, rows: slice = slice(None)) -> np.ndarray:
    """1 / (1 + distance of centres); with vectors the mean of that and their cosine. `rows` of it alone, if given."""
    centre = np.stack([boxes[:, [0, 2]].mean(1), boxes[:, [1, 3]].mean(1)], 1)
    near = 1 / (1 + np.linalg.norm(centre[rows, None] - centre[None], axis=2))
    if vectors is None:
        return near
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return (near + unit[rows] @ unit.T) / 2


def far_spectrum(boxes: np.ndarray, vectors: np.ndarray | None, most: int) -> np.ndarray:
    """`spectrum` of the affinity of many boxes, of which ROWS rows are held at a time: spaces of powers, each with what the
    ones before it leave, until the vectors wanted are the matrix's own to the last digits but few."""
    n = len(boxes)

    def applied(q: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.concatenate([scale[k : k + ROWS, None] * (affinity(boxes, vectors, slice(k, k + ROWS)) @ (scale[:, None] * q)) for k in range(0, n, ROWS)])

    weight = applied(np.ones((n, 1)), np.ones(n))[:, 0]
    scale = 1 / (np.sqrt(np.maximum(weight, 0)) + 1e-10)
    new = np.linalg.qr(np.concatenate([np.sqrt(np.maximum(weight, 0))[:, None], np.random.default_rng(0).standard_normal((n, 2 * most))], 1))[0]
    base, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(SPACES):
        image_new = applied(new, scale)
        base, image = np.concatenate([base, new], 1), np.concatenate([image, image_new], 1)
        value, turn = np.linalg.eigh(base.T @ image)
        turn, value = turn[:, ::-1][:, :most], value[::-1][:most]
        found = base @ turn
        if np.linalg.norm(image @ turn - found * value, axis=0).max() < 1e-11:
            break
        new = image_new
        for _ in range(2):  # twice is enough to be orthogonal to all before
            new = np.linalg.qr(new - base @ (base.T @ new))[0]
    return found * np.where(found[np.abs(found).argmax(0), np.arange(most)] < 0, -1, 1)


def spectrum(weights: np.ndarray, most: int) -> np.ndarray:
    """The eigenvectors of the normalised Laplacian's least eigenvalues, each with its largest entry positive."""
    scale = 1 / (np.sqrt(np.maximum(weights.sum(1), 0)) + 1e-10)
    _, v = np.linalg.eigh(np.eye(len(weights)) - scale[:, None] * weights * scale[None])
    v = v[:, :most]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def k_means(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Labels; seeds are the first point and then always the one farthest from all seeds, so reruns agree."""
    seeds = [0]
    away = ((points - points[0]) ** 2).sum(1)
    while len(seeds) < k:
        seeds.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[seeds[-1]]) ** 2).sum(1))
    centres = points[seeds]
    labels = None
    for _ in range(rounds):
        new = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = np.stack([points[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
    return labels


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; a point alone in its group counts 0. -1 for fewer than two groups."""
    groups = np.unique(labels)
    if len(groups) < 2:
        return -1.0
    sizes = np.array([(labels == g).sum() for g in groups])
    own = np.searchsorted(groups, labels)
    i = np.arange(len(points))
    inside = [labels == g for g in groups]
    sums = []
    for k in range(0, len(points), ROWS):  # some rows of the distances at a time
        apart = np.linalg.norm(points[k : k + ROWS, None] - points[None], axis=2)
        sums.append(np.stack([apart[:, g].sum(1) for g in inside], 1))
    sums = np.concatenate(sums)
    a = sums[i, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[i, own] = np.inf
    b = means.min(1)
    return float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def group_boxes(boxes: np.ndarray, vectors: np.ndarray | None = None, most: int = 10, how: str = "best") -> np.ndarray:
    """A group for each box, numbered as first seen; -1 for all if there are fewer than three boxes, which have no silhouette.

    Of 2 to `most` groups, the number with the best silhouette over the first `most` eigenvectors is taken, which may well
    be larger than the number of visible clumps. best: groups by as many eigenvectors as there are groups are tried for every
    number. heuristic: groups by all `most` eigenvectors are tried, and the number found is then used as under best.
    """
    if how not in ("best", "heuristic"):
        raise ValueError(f"no such way: {how}")
    n = len(boxes)
    if n < 3:
        return np.full(n, -1)
    points = spectrum(affinity(boxes, vectors), most) if n <= WHOLE else far_spectrum(boxes, vectors, most)
    tried = {k: k_means(points[:, :k] if how == "best" else points, k) for k in range(2, min(most, n - 1) + 1)}
    k = max(tried, key=lambda k: round(silhouette(points, tried[k]), 9))  # the smallest k of equal ones
    best = tried[k] if how == "best" else k_means(points[:, :k], k)
    order: dict[int, int] = {}
    return np.array([order.setdefault(int(x), len(order)) for x in best])


def clusters(boxes: DataFrame, vector: str | None = None, most: int = 10, how: str = "best") -> DataFrame:
    """page, box_id, cluster. boxes: page, box_id, box, and with `vector` an array column; boxes without one get -1.

    The spectrum needs a page's boxes in one place; a page has as many as a layout model finds on it.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("box_id")
        used = np.ones(len(rows), bool) if vector is None else rows["v"].notna().to_numpy()
        vectors = None if vector is None or not used.any() else np.stack([np.asarray(v, float) for v in rows["v"][used]])
        found = np.full(len(rows), -1)
        found[used] = group_boxes(rows[["x0", "y0", "x1", "y1"]].to_numpy(float)[used], vectors, most, how)
        return pd.DataFrame({"page": rows["page"], "box_id": rows["box_id"], "cluster": found.astype("int64")})

    flat = boxes.select("page", "box_id", "box.*", *([] if vector is None else [F.col(vector).alias("v")]))
    # A page takes far longer than its bytes tell, so tasks aren't put together.
    tasks = max(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * boxes.sparkSession.sparkContext.defaultParallelism)
    return flat.repartition(tasks, "page").groupBy("page").applyInPandas(one, "page long, box_id long, cluster long")


def split_by_budget(rows: DataFrame, by: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """by, order, part: members in order, a new part (from 0) before one that would take its part over the budget.

    Members stream through their task in order; only the open part is carried from one to the next.
    """
    kept = rows.select(*by, order, tokens)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, order]) + ", part int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, used = None, 0, 0
        for batch in batches:
            parts = []
            for *key, n in zip(*(batch.column(c).to_pylist() for c in [*by, tokens]), strict=True):
                n = n or 0
                if key != group:
                    group, part, used = key, 0, 0
                if used > 0 and used + n > budget:
                    part, used = part + 1, 0
                used += n
                parts.append(part)
            yield pa.record_batch([*(batch.column(c) for c in [*by, order]), pa.array(parts, pa.int32())], [*by, order, "part"])

    return kept.repartition(*by).sortWithinPartitions(*by, order, tokens).mapInArrow(split, schema)


def _unit() -> Column:
    """Boxes of a cluster are one unit; a box of cluster -1 is one of its own."""
    lone = F.coalesce(F.col("cluster"), F.lit(-1)) < 0
    return F.struct(lone.alias("lone"), F.when(lone, F.col("box_id")).otherwise(F.col("cluster")).cast("long").alias("id"))


def merge_words(units: DataFrame) -> DataFrame:
    """page, place, label, words: the words of each cluster's boxes in reading order; the commonest label, first seen of equal ones.

    units: page, box_id, place (reading order), label, cluster, words.
    """
    u = units.withColumn("unit", _unit())
    counts = u.groupBy("page", "unit", "label").agg(F.count("*").alias("n"), F.min("place").alias("seen"))
    mode = counts.groupBy("page", "unit").agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"))
    joined = u.groupBy("page", "unit").agg(F.min("place").alias("place"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "box_id", "words"))), lambda x: x["words"])).alias("words"))
    return joined.join(mode, ["page", "unit"]).select("page", "place", "label", "words")


def crop_boxes(boxes: DataFrame) -> DataFrame:
    """page, crop, label, x0, y0, x1, y1: the union of each cluster's boxes with the label of the largest area; lone boxes come first."""
    flat = boxes.select("page", "box_id", "label", "cluster", "box.*").withColumn("unit", _unit())
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    labels = flat.groupBy("page", "unit", "label").agg(F.sum(area).alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("box_id").alias("seen"))
    whole = labels.groupBy("page", "unit").agg(F.max_by("label", F.struct(F.round("area", 9), -F.col("seen"))).alias("label"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    order = Window.partitionBy("page").orderBy(F.desc("unit.lone"), "unit.id")
    return whole.withColumn("crop", F.row_number().over(order) - 1).select("page", "crop", "label", "x0", "y0", "x1", "y1")
