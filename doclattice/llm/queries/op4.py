"""Query op4_language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language import fit, predict
from ..shared import read_table

NAME = "op4_language"
SQL = None


def remainder():
    """Held-out documents have remainder 2."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = fit(docs, F.coalesce(remainder() != 2, F.lit(True)))
    found = predict(docs.select("doc_id", "text"), field)
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
