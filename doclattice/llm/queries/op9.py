"""Query op9_line_dedup: every document with the lines that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lines import dedup_lines
from ..shared import read_table

NAME = "op9_line_dedup"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")
