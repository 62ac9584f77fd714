"""Query op7_fingerprints: fingerprints of every text and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..neighbours import with_next
from ..shared import read_table
from ..winnow import add_marks, digest, edit_start, hashes, likeness, spliced

NAME = "op7_fingerprints"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    marked = lambda df: add_marks(df, "text", "marks").withColumn("own", hashes("marks"))
    pairs = with_next(docs, "doc_id", "tie", {"next_text": "text", "next_own": "own"}, marked)
    n = F.char_length("text").cast("long")
    half = "cast(floor(char_length(text) / 2) as int)"
    edited = F.expr(f"concat(substring(text, 1, char_length(text) - {half}), substring(next_text, 1, {half}))")
    pairs = pairs.withColumn("kept", F.expr(f"char_length(text) - {half}")).withColumn("edited", edited)
    pairs = pairs.select("doc_id", n.alias("n_chars"), digest("marks").alias("fingerprint"), "marks", "own", "kept", likeness("own", "next_own").alias("near_next"), F.sha2("edited", 256).alias("edited_sha256"), "edited")
    # the first half is the text's own: its marks are known, and only the rest is read again
    pairs = pairs.withColumn("tail", F.expr(f"substring(edited, {edit_start('kept')} + 1, char_length(edited))")).drop("edited")
    pairs = add_marks(pairs, "tail", "tail_marks").drop("tail").withColumn("edited_marks", spliced("marks", "tail_marks", "kept"))
    pairs = pairs.withColumn("theirs", hashes("edited_marks")).withColumn("edited_fingerprint", digest("edited_marks"))
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("own", "theirs").alias("near_edited"), "near_next")
