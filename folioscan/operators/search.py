"""Exact search of vectors against a whole corpus: blocks of the corpus stand still, and queries pass by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block at most, which a task holds, and at least, if there are tasks to spare.
MOST, LEAST = 25_000, 500
#: Similarities that a task holds at a time.
CELLS = 500_000
#: Decimals of a similarity by which vectors are ranked: sums in other orders differ further behind.
DECIMALS = 9

_Told = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _passed(queries: DataFrame, corpus: DataFrame, tell: Callable[[], _Told], schema: str) -> DataFrame:
    """What `tell` makes of every query's similarities to each block of the corpus.

    queries: id, vector; corpus: id, part (any long), vector; null vectors are nobody's neighbours. The corpus is dealt once,
    in blocks of equal size; each query is sent to every block. The similarity is the dot product over the product of norms.
    """
    spark = corpus.sparkSession
    n = corpus.count()
    blocks = max(1, -(-n // MOST), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    held = corpus.filter(F.col("vector").isNotNull()).select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("query"), "id", "part", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = queries.filter(F.col("vector").isNotNull()).select(every, F.lit(1).alias("query"), "id", F.lit(0).cast("long").alias("part"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = tell()
        ids, parts, vectors = [], [], []
        block = None
        for batch in batches:
            first = int(np.searchsorted(batch.column("query").to_numpy(), 1))
            if first:
                part = batch.slice(0, first)
                ids.append(part.column("id").to_numpy())
                parts.append(part.column("part").to_numpy())
                vectors.append(_matrix(part.column("vector")))
            if first == batch.num_rows or not ids:
                continue
            if block is None:
                block = np.concatenate(vectors)
                vectors = []
                own, group, norms = np.concatenate(ids), np.concatenate(parts), np.sqrt(np.einsum("ij,ij->i", block, block))
            asking = batch.slice(first)
            q, names = _matrix(asking.column("vector")), asking.column("id").to_numpy()
            step = max(1, CELLS // len(block))
            for k in range(0, len(q), step):
                part = q[k : k + step]
                near, over = part @ block.T, np.sqrt((part**2).sum(1))[:, None] * norms
                over += 1e-8
                near /= over
                yield told(names[k : k + step], own, group, np.round(near, DECIMALS, out=near))

    rows = held.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("query")
    return rows.select("query", "id", "part", "vector").mapInArrow(run, schema)


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """question, chunk, sim, rank: the k vectors of the corpus (id, vector) that are most similar to each query (id, vector).

    All of the corpus is searched, but for the row of the query's own id. Of equal similarities (to DECIMALS) the least id
    comes first. Each block tells its k best; they are ranked once more by query.
    """

    def tell() -> _Told:
        def told(names: np.ndarray, own: np.ndarray, group: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            near[names[:, None] == own] = -np.inf
            most = min(k, near.shape[1])
            least = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
            out = []
            for i, row in enumerate(near):
                at = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                if len(at) > most:  # ties at the end
                    at = at[np.lexsort((own[at], -row[at]))[:most]]
                out.append((np.full(len(at), names[i]), own[at], row[at]))
            return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["question", "chunk", "sim"])

        return told

    found = _passed(queries, corpus.withColumn("part", F.lit(0).cast("long")), tell, "question long, chunk long, sim double")
    order = Window.partitionBy("question").orderBy(F.desc("sim"), "chunk")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_of_parts(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """question, part, sim: the similarity of each query (id, vector) to the most similar vector of each part of the corpus
    (id, part, vector). Blocks tell their best of each part."""

    def tell() -> _Told:
        def told(names: np.ndarray, own: np.ndarray, group: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - 1))
            best = np.maximum.reduceat(near[:, order], starts, axis=1)
            parts = group[order][starts]
            return pa.record_batch([pa.array(np.repeat(names, len(parts))), pa.array(np.tile(parts, len(names))), pa.array(best.ravel())], ["question", "part", "sim"])

        return told

    found = _passed(queries, corpus, tell, "question long, part long, sim double")
    return found.groupBy("question", "part").agg(F.max("sim").alias("sim"))
