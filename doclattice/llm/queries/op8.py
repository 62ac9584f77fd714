"""Query op8_mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..mixing import mix
from ..shared import read_table

NAME = "op8_mixing"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
