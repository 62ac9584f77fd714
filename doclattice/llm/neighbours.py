"""The next row in an order over the whole table, without a single-task window [native]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS, FINE, MOST = 500, 64, 4096


def _bucket(id_col: str, tie: str, bounds: list[int]) -> str:
    """SQL for the number of bounds below an id; found first among every 64th bound, then among the 64 there. Nulls: 64 buckets below, by the tie."""
    parts = [bounds[i : i + FINE] for i in range(0, len(bounds), FINE)]
    if not parts:
        return f"cast(if({id_col} is null, shiftright({tie}, 58) - 100, 0) as int)"
    heads = ", ".join(f"{p[0]}L" for p in parts)
    inner = ", ".join("array(" + ", ".join(f"{b}L" for b in p) + ")" for p in parts)
    at = f"size(filter(array({heads}), b -> b < {id_col}))"
    return f"""cast(case when {id_col} is null then shiftright({tie}, 58) - 100 when {at} = 0 then 0
        else ({at} - 1) * {FINE} + size(filter(element_at(array({inner}), {at}), b -> b < {id_col})) end as int)"""


def with_next(df: DataFrame, id_col: str, tie: str, carried: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Adds ``carried`` columns (new name -> column) of the next row by descending ``id_col``; after the last row comes the first.

    Ids equal or null (last) go by descending ``tie`` (a long). Rows are dealt to buckets of about 500 by ranges of ids, whose bounds are
    quantiles found in one aggregate (4096 at most), and a copy of each bucket's first row is laid after the last
    row of the bucket above, so that the window stays within buckets. ``prepare`` is applied once the rows are dealt, before the window. The
    driver sees the bounds and one id and tie of each bucket, never more. Beyond ``MOST * ROWS`` rows the buckets grow, and equal ids share one; names that begin with two underscores are the function's own.
    """
    n = df.count()
    buckets = min(MOST, n // ROWS)
    bounds: list[int] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        bounds = sorted({int(b) for b in df.agg(F.percentile_approx(id_col, at, 10000)).first()[0] or []})
    dealt = df.withColumn("__b", F.expr(_bucket(id_col, tie, bounds)))
    first = sorted(dealt.groupBy("__b").agg(F.max(F.struct(id_col, tie)).alias("m")).select("__b", "m.*").collect(), reverse=True)
    copies = [(r[0], r[1], r[2], first[i - 1][0]) for i, r in enumerate(first)]
    tops = df.sparkSession.createDataFrame(copies, "__b int, __id long, __tie long, __to int")
    marked = dealt.join(F.broadcast(tops), "__b", "left")
    is_top = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(tie).eqNullSafe(F.col("__tie"))
    here, there = F.struct(F.col("__b").alias("__at"), F.lit(0).alias("__copy")), F.struct(F.col("__to").alias("__at"), F.lit(1).alias("__copy"))
    spread = marked.select(*df.columns, F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))).alias("__where")).select(*df.columns, "__where.*")
    ready = prepare(spread.repartition("__at"))
    order = W.partitionBy("__at").orderBy(F.col("__copy"), F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    ahead = ready.select("*", *[F.lead(c).over(order).alias(new) for new, c in carried.items()])
    return ahead.where("__copy = 0").drop("__at", "__copy")
