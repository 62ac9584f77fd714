"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps. All but the
last return the columns of their input, whatever their names.

Defined cases are those of the operators: null, empty and very long texts are scored, compared and counted whole; documents without words are near-duplicates of
each other; repeated rows are rows of their own for quality, mixing and packing, keep their lines once and are near-duplicates; null ids come last; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.lines import dedup_lines
from doclattice.llm.mixing import mixed
from doclattice.llm.packing import pack_documents
from doclattice.llm.quality import fit, keep_good
from doclattice.llm.shared import materialize, read_table
from doclattice.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents that op2 may learn from."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return keep_good(docs, fit(docs, read_table(spark, sf_dir, "labels"), learn))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines one stays; ``n_chars`` follows the text."""
    kept = dedup_lines(docs, lines_out="_n", kept_out="_k").drop("_n", "_k")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by SimHash over five-word shingles, verified by their exact similarity of 0.8 or more."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document (repeats counted)."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
