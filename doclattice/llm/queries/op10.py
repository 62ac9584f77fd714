"""Query op10_packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..packing import pack_documents
from ..shared import read_table

NAME = "op10_packing"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
