"""Packing by optimal length buckets.

The histogram of lengths over all rows goes to the driver, where dynamic programming chooses the bucket
boundaries with the least padding. Inside each bucket, batches hold as many rows as the token budget allows at the bucket's
length. Rows are numbered within shards of a bucket and shards by their counts, so that no bucket, whatever its share, meets in one task. Shards go by id and
length, and rows equal in both are one entry until they are numbered: batches don't depend on how the rows are laid out.

Defined cases: a null text has length 0; a length above the budget makes batches of one; lengths beyond ``EXACT`` are counted at the
next of 1024 steps to the power of two, which bounds the histogram; the padding is within 0.1 % of the tokens of
such rows of the least; a text of any length is counted whole; equal lengths go by id; repeated rows are rows of their own; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mixing import sized
from .shared import materialize

BUCKETS, BUDGET, SHARD, EXACT = 16, 32768, 8192, 65536


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Upper ends of at most ``buckets`` buckets over ascending ``lengths``, and the padding they leave, which is the least.

    For a bucket (i, j] the padding is ``length[j] * (rows to j - rows to i) - (tokens to j - tokens to i)``: for given j a minimum over
    lines in ``length[j]``, which the lower envelope of the lines answers in one pass for ascending lengths.
    """
    n = len(lengths)
    if not n:
        return [], 0
    x = [int(v) for v in lengths]
    rows, tokens = [0, *np.cumsum(counts).tolist()], [0, *np.cumsum(lengths * counts).tolist()]
    best: list[float] = [0] + [float("inf")] * n
    choice = []
    answer = (float("inf"), 0)
    for b in range(1, min(buckets, n) + 1):
        now, back = [float("inf")] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope (falling), intercept, i
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] != float("inf"):
                m, c = -rows[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) - at >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, j - 1))
            if not hull:
                continue
            at = min(at, len(hull) - 1)
            v = x[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * v + hull[at + 1][1] <= hull[at][0] * v + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * v + hull[at][1] + v * rows[j] - tokens[j]
            back[j] = hull[at][2]
        choice.append(back)
        if now[n] < answer[0]:
            answer = (now[n], b)
        best = now
    ends, j = [], n
    for b in range(answer[1], 0, -1):
        ends.append(x[j - 1])
        j = choice[b - 1][j]
    return ends[::-1], int(answer[0])


def _counted(length: str) -> Column:
    """Lengths as the histogram counts them."""
    step = F.greatest(F.lit(1), F.expr(f"cast(power(2, greatest(0, floor(log2(greatest({length}, 1))) - 10)) as bigint)"))
    return F.when(F.col(length) <= EXACT, F.col(length)).otherwise((F.ceil(F.col(length) / step) * step).cast("long"))


def pack(rows: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """Per row of ``rows``: id, ``n_tokens``, ``bucket``, ``bucket_length``, ``batch`` (within the bucket) and ``slot`` (within the batch)."""
    slim = rows.select(F.col(f"`{id_col}`").alias("id"), length.cast("long").alias("n"))
    # rows with the same id and length can't be told apart in the result: they are one entry with a count
    slim = materialize(slim.groupBy("id", "n").agg(F.count(F.lit(1)).alias("rows")).withColumn("counted", _counted("n")), "lengths")
    seen = sorted((r[0], r[1]) for r in slim.groupBy("counted").agg(F.sum("rows")).collect())
    x, c = np.array([s[0] for s in seen], np.int64), np.array([s[1] for s in seen], np.int64)
    ends, _ = boundaries(x, c, buckets)
    ends = ends or [0]
    held = [int(c[(x > low) & (x <= high)].sum()) for low, high in zip([-1, *ends], ends, strict=False)]
    lit = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    bucket = F.size(F.filter(lit(ends), lambda e: e < F.col("counted")))
    shards = F.element_at(lit([max(1, -(-h // shard)) for h in held]), F.col("bucket") + 1)
    dealt = slim.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("id", "n"), shards))
    sizes = dealt.groupBy("bucket", "shard").agg(F.sum("rows").alias("count"))
    before = sizes.withColumn("before", F.sum("count").over(W.partitionBy("bucket").orderBy("shard")) - F.col("count")).drop("count")
    number = F.sum("rows").over(W.partitionBy("bucket", "shard").orderBy(F.desc("n"), "id")) - F.col("rows")
    placed = dealt.withColumn("number", number).join(before, ["bucket", "shard"])
    placed = placed.select("id", "n", "bucket", F.explode(F.expr("sequence(before + number, before + number + rows - 1)")).alias("at"))
    room = F.element_at(lit([max(1, budget // max(e, 1)) for e in ends]), F.col("bucket") + 1)
    end = F.element_at(lit(ends), F.col("bucket") + 1)
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", end.alias("bucket_length"), F.floor(F.col("at") / room).alias("batch"), (F.col("at") % room).alias("slot"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(docs, sized(F.col(f"`{text_col}`")), id_col)
