"""Layout inputs derived from the test tables by fixed integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve words a row, 45 rows a page; the first row is a running head, odd documents have two columns."""
    split = F.expr("filter(split(replace(text, '\n', ' '), ' '), w -> w <> '')")
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split).alias("word_seq", "text"))
    j = F.col("word_seq")
    w = w.withColumn("k", j % 12).withColumn("g", F.floor(j / 12).cast("int")).withColumn("u", F.col("g") % 45)
    odd = F.col("doc_id") % 2 == 1
    x0 = 48 + 44 * F.col("k") + F.when(odd & (F.col("k") >= 6), 24).otherwise(0)
    top = F.when(F.col("u") == 0, 12).otherwise(36 + 14 * F.col("u") + 8 * F.floor(F.col("u") / 7)) + F.col("k") % 3
    narrow = F.when(odd & (F.char_length("text") % 5 == 0), 8).otherwise(0)
    return w.select(
        "doc_id", (F.floor(F.col("g") / 45) + 1).cast("int").alias("page_no"), "word_seq", "text", x0.cast("double").alias("x0"), (x0 + 40 - narrow).cast("double").alias("x1"),
        top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), (j % 97 != 0).alias("upright"),
    )


#: The same in DuckDB.
WORDS_SQL = """words AS (
  SELECT doc_id, ((j // 12) // 45 + 1)::INT AS page_no, j::INT AS word_seq, w AS text,
    (48 + 44 * (j % 12) + CASE WHEN doc_id % 2 = 1 AND j % 12 >= 6 THEN 24 ELSE 0 END)::DOUBLE AS x0,
    (48 + 44 * (j % 12) + CASE WHEN doc_id % 2 = 1 AND j % 12 >= 6 THEN 24 ELSE 0 END + 40 - CASE WHEN doc_id % 2 = 1 AND len(w) % 5 = 0 THEN 8 ELSE 0 END)::DOUBLE AS x1,
    (CASE WHEN (j // 12) % 45 = 0 THEN 12 ELSE 36 + 14 * ((j // 12) % 45) + 8 * (((j // 12) % 45) // 7) END + (j % 12) % 3)::DOUBLE AS top,
    (CASE WHEN (j // 12) % 45 = 0 THEN 12 ELSE 36 + 14 * ((j // 12) % 45) + 8 * (((j // 12) % 45) // 7) END + (j % 12) % 3 + 10)::DOUBLE AS bottom,
    j % 97 <> 0 AS upright
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM
    (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM documents)))"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    page = lines.withColumn("page_no", (F.floor(F.col("i") / 4) + 1).cast("int"))
    return page.groupBy("doc_id", "page_no").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(i, line))), x -> x.line)"), "\n").alias("source_text"))


PAGE_TEXTS_SQL = """page_texts AS (
  SELECT doc_id, (i // 4 + 1)::INT AS page_no, string_agg(line, chr(10) ORDER BY i) AS source_text FROM
    (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) GROUP BY ALL)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a line that isn't blank."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "text"))
    return lines.where(F.trim("text") != "").withColumn("page_no", (F.floor(F.col("chunk_no") / 4) + 1).cast("int"))


CHUNKS_SQL = """chunks AS (
  SELECT doc_id, i::INT AS chunk_no, (i // 4 + 1)::INT AS page_no, line AS text FROM
    (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> '')"""


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each page but every fifth."""
    pages = page_texts(spark, sf_dir).select("doc_id", "page_no").where("page_no % 5 <> 0")
    return pages.withColumn("image_path", F.format_string("page-%d-%03d.png", "doc_id", "page_no"))


def tex_files(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """Two files a document: a main file with a section, a formula and a table, and a bare fragment. ``text`` takes the place of the documents' texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("text") if text is None else text).alias("text"))
    title = F.expr("array_join(slice(split(replace(text, '\n', ' '), ' '), 1, 5), ' ')")
    head = F.expr(r"slice(split(replace(text, '\n', ' '), ' '), 1, 3)")
    cells = F.array_join(F.transform(head, lambda x: F.concat(x, F.lit(" cell"))), " & ")
    body = F.concat(F.lit("\\section{"), title, F.lit("}\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\nWe see $x_1$ and \\cite{a} here. % a note\n\n\\begin{tabular}{lll}\n"), cells, F.lit(" \\\\\n\\end{tabular}\n"))
    main = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n"), body, F.lit("\\end{document}\n"))
    both = F.array(F.struct(F.lit("main.tex").alias("path"), main.alias("content")), F.struct(F.lit("sub/part.tex").alias("path"), F.col("text").alias("content")))
    return docs.select(F.col("doc_id").alias("project_id"), F.explode(both).alias("f")).select("project_id", "f.*")


TEX_FILES_SQL = r"""tex_files AS (
  SELECT doc_id AS project_id, 'main.tex' AS path, '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || '\section{' ||
    array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:5], ' ') || '}' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) ||
    'We see $x_1$ and \cite{a} here. % a note' || chr(10) || chr(10) || '\begin{tabular}{lll}' || chr(10) ||
    array_to_string(list_transform(string_split(replace(text, chr(10), ' '), ' ')[1:3], lambda x: x || ' cell'), ' & ') || ' \\' || chr(10) || '\end{tabular}' || chr(10) || '\end{document}' || chr(10) AS content
  FROM documents UNION ALL SELECT doc_id, 'sub/part.tex', text FROM documents)"""


#: State that an event of each type sets.
STATES = {"signup": "queued", "view": "running", "click": "progress", "purchase": "complete", "error": "error"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job events: user is job; ``seq`` orders them; ``percent`` comes with progress."""
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("state", state)
    percent = F.when(F.col("state") == "progress", F.abs(F.col("value").cast("int")) % 101)
    return e.where("state is not null").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", "state", percent.cast("long").alias("percent"))


JOB_EVENTS_SQL = """job_events AS (
  SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' END AS state,
    CASE WHEN event_type = 'click' THEN (abs(trunc(value)::INT) % 101)::BIGINT END AS percent
  FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase', 'error'))"""
