"""Query op2_quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality import CUT, fit, score
from ..shared import read_table

NAME = "op2_quality"
SQL = None


def remainder():
    """Held-out documents have remainder 0."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, read_table(spark, sf_dir, "labels"), remainder() != 0)
    scored = score(docs, net)
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
