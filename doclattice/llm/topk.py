"""Exact top-k inner product search with block-at-a-time pruning.

Rows are cut into document ranges (the batches of a scan), and each range into blocks with the largest and smallest value of every
component. For a query, a block's bound is the sum over components of the larger of the query's value times
either; blocks are scored through their forward index (the block's vectors) from the highest bound
down until the bound falls below the k-th best score. That score is carried from range to range, and begins with the k-th
best of a few rows that the driver has seen. Queries go with the tasks, a bounded number in each pass over the documents, which are neither shuffled nor copied; a task
returns at most k rows for a query.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; shorter vectors count as ended by zeros; ids
may repeat, each row being a row of its own (a query leaves out itself alone); of equal scores the smaller id comes
first, null ids last; scores past the range of a long are an error of the input and wrap; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import folder, materialize

#: Rows of a block, queries that one pass over the documents takes, and rows that give the first bounds of the k-th scores.
BLOCK, QUERIES, SEED = 256, 4096, 2048


def _matrix(column: pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    dim = int(size.max(initial=0)) if dim is None else dim
    out = np.zeros((len(rows), dim), np.int64)
    if len(size) and (size == dim).all():
        out[:] = flat[offsets[0] : offsets[-1]].reshape(len(rows), dim)
    else:
        row = np.repeat(np.arange(len(rows)), size)
        out[row, np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]] = flat[offsets[0] : offsets[-1]]
    return out


class Best:
    """The best rows of one query so far: places, ids, scores, the best first; ``floor`` is a score that the k-th best reaches at least."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def least(self) -> float:
        return max(self.floor, self.score[-1]) if len(self.row) == self.k else self.floor

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        use = score >= self.least()
        row, ids, score = (np.concatenate(p) for p in ((self.row, row[use]), (self.id, ids[use]), (self.score, score[use])))
        order = np.lexsort((row, ids, -score))[: self.k]
        self.row, self.id, self.score = row[order], ids[order], score[order]


def search(docs: np.ndarray, row: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, best: Best) -> int:
    """Scores the blocks of a range, the highest bound first, until the bounds fall below the k-th score; returns how many it scored. ``ids`` has the largest long for null."""
    done = 0
    for b in np.argsort(-bound, kind="stable").tolist():
        if bound[b] < best.least():
            break
        at = slice(b * BLOCK, (b + 1) * BLOCK)
        use = row[at] != own
        best.add(row[at][use], ids[at][use], (docs[at] @ query)[use])
        done += 1
    return done


def bounds(docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For every query and block of a range the sum over components of the largest products: no row of the block scores higher."""
    starts = np.arange(0, len(docs), BLOCK)
    high, low = np.maximum.reduceat(docs, starts, axis=0), np.minimum.reduceat(docs, starts, axis=0)
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _fitting(*sides: np.ndarray) -> list[np.ndarray]:
    """Matrices of one width; as doubles where all sums of products are exact in them."""
    dim = max(s.shape[1] for s in sides)
    sides = [np.pad(s, ((0, 0), (0, dim - s.shape[1]))) for s in sides]
    top = np.prod([float(np.abs(s).max(initial=0)) for s in sides]) * max(dim, 1)
    return [s.astype(np.float64) for s in sides] if top < 2**53 else sides


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, id, score`` over components ``floor(scale * x)``; ``is_query`` is a condition on ``id``."""
    whole = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e"))
    finite = "e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    quantised = whole.where(finite).select("id", F.expr(f"transform(e, x -> floor({scale} * x))").alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(quantised, "vectors")
    asked = rows.where(is_query)
    chunks = -(-asked.count() // QUERIES)
    seed = rows.limit(SEED).toArrow()  # any rows will do: their k-th best score bounds that of all rows from below
    path = folder(vectors.sparkSession, "topk")
    fields = "query_row long, query_id long, row long, id long, score long"
    for chunk in range(chunks):
        # QUERIES rows, about, come to the driver and go with the tasks of one pass; the documents stay where they are
        found = rows.mapInArrow(_meeting(asked.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).toArrow(), seed, k), fields)
        found.write.mode("append").parquet(path)
    if not chunks:
        rows.select(*[F.lit(0).cast("long").alias(c.split()[0]) for c in fields.split(", ")]).where("false").write.parquet(path)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))
    ranked = vectors.sparkSession.read.schema(fields).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("id") < 2**63 - 1, F.col("id")).alias("id"), "score")


def _meeting(asked: pa.Table, seed: pa.Table, k: int):
    """A function for one pass: batches of documents are ranges; the best rows of every query are carried from range to range."""
    own, name, q0 = asked["row"].to_numpy(), asked["id"].to_pylist(), _matrix(asked["v"])
    floors = np.full(len(own), -np.inf)
    if seed.num_rows > k and len(own):
        d, q = _fitting(_matrix(seed["v"]), q0)
        for at in range(0, len(own), 256):
            score = q[at : at + 256] @ d.T
            same = own[at : at + 256, None] == seed["row"].to_numpy()[None, :]
            score = np.where(same, np.iinfo(np.int64).min // 2, score)
            floors[at : at + 256] = np.partition(score, -k, axis=1)[:, -k]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, f) for f in floors.tolist()]
        for batch in batches:
            if batch.num_rows:
                d, q = _fitting(_matrix(batch["v"]), q0)
                row, ids = batch["row"].to_numpy(), batch["id"].fill_null(2**63 - 1).to_numpy()
                limit = bounds(d, q)
                for i, b in enumerate(best):
                    search(d, row, ids, q[i], own[i], limit[i], b)
        n = [len(b.row) for b in best]
        values = [np.repeat(own, n), pa.array([name[i] for i, c in enumerate(n) for _ in range(c)], pa.int64())]
        values += [np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for b in best)]).astype(np.int64) for c in ("row", "id", "score")]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["query_row", "query_id", "row", "id", "score"])

    return meet
