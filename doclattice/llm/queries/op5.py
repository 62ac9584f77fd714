"""Query op5_topk and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import read_table
from ..topk import top_k

NAME = "op5_topk"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS query_row, q.vec_id AS query_id, d.vec_id, d.row, list_dot_product(q.e, d.e)::BIGINT AS score FROM v q JOIN v d ON q.row <> d.row WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS rank FROM s) WHERE rank <= 10
"""
