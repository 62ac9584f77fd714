"""Chunks, batches, limits, translation and reassembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT, batch_limits
from ..functions.limits import LIMITS, job_memory_mb, limit
from ..functions.text import squeeze
from ..operators.folds import greedy_batches, paginate
from ..operators.segments import page_chunks, sentence_pieces, wrap_lines
from ..operators.translate import (
    CopyTranslator,
    FunctionTranslator,
    TranslationError,
    assemble_pages,
    copy_expression,
    dedupe_keys,
    translate_batches,
    translate_deduped,
    translate_pages,
    translate_regions,
    zip_fallback,
)
from ..sources.testdata import CHUNKS_SQL, PAGE_TEXTS_SQL, chunks, page_texts, table
from .registry import query


def greedy_sql(rows: str, keys: str, order: str, size: str, items: int | None, most: int) -> str:
    """A recursive walk over the rows of each key: ``b(keys, rn, batch_id)`` over ``r``."""
    full = f"w.items >= {items} OR " if items else ""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn, ({size})::BIGINT AS n FROM {rows}),
w AS (SELECT {keys}, rn, 0::BIGINT AS batch_id, 1 AS items, n AS total FROM r WHERE rn = 1
  UNION ALL SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, r.rn, CASE WHEN {full}w.total + r.n > {most} THEN w.batch_id + 1 ELSE w.batch_id END,
    CASE WHEN {full}w.total + r.n > {most} THEN 1 ELSE w.items + 1 END, CASE WHEN {full}w.total + r.n > {most} THEN r.n ELSE w.total + r.n END
  FROM w JOIN r ON {' AND '.join(f'r.{k.strip()} = w.{k.strip()}' for k in keys.split(','))} AND r.rn = w.rn + 1),
b AS (SELECT r.*, w.batch_id FROM r JOIN w USING ({keys}, rn))"""


_COPY = "CASE WHEN trim(text) = '' THEN '' ELSE '[Copy only]' || chr(10) || trim(text) END"


@query("entry_copy_translate", f"""WITH RECURSIVE {CHUNKS_SQL}, {greedy_sql('chunks', 'doc_id', 'chunk_no', 'len(text)', 24, 8000)}
SELECT doc_id, count(*) AS n_chunks, max(batch_id) + 1 AS n_batches, sum(n)::BIGINT AS n_chars, string_agg({_COPY}, chr(10) || chr(10) ORDER BY chunk_no) AS translated_text FROM b GROUP BY doc_id""")
def entry_copy_translate(spark, sf_dir):
    items, chars = batch_limits("copy", "fast")
    sized = chunks(spark, sf_dir).withColumn("n", F.char_length("text").cast("long"))
    done = greedy_batches(sized, ["doc_id"], ["chunk_no"], "n", items, chars).withColumn("t", copy_expression(F.col("text")))
    counts = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), (F.max("batch_id") + 1).alias("n_batches"), F.sum("n").alias("n_chars"))
    return counts.join(assemble_pages(done, ["doc_id"], "chunk_no", "t"), "doc_id")


@query("greedy_batches", f"WITH RECURSIVE {CHUNKS_SQL}, {greedy_sql('chunks', 'doc_id', 'chunk_no', 'len(text)', 16, 4800)} SELECT doc_id, chunk_no, n, batch_id FROM b")
def q_greedy(spark, sf_dir):
    items, chars = batch_limits("copy", "quality")
    sized = chunks(spark, sf_dir).select("doc_id", "chunk_no", F.char_length("text").cast("long").alias("n"))
    return greedy_batches(sized, ["doc_id"], ["chunk_no"], "n", items, chars)


@query("tex_batches", f"WITH RECURSIVE {CHUNKS_SQL}, {greedy_sql('chunks', 'doc_id', 'chunk_no', 'len(text)', 8, 5000)} SELECT doc_id, chunk_no, batch_id FROM b")
def q_tex_batches(spark, sf_dir):
    sized = chunks(spark, sf_dir).select("doc_id", "chunk_no", F.char_length("text").alias("n"))
    return greedy_batches(sized, ["doc_id"], ["chunk_no"], "n", DEFAULT.tex_items, DEFAULT.tex_chars).drop("n")


@query("overlay_batches", f"WITH RECURSIVE {CHUNKS_SQL}, {greedy_sql('chunks', 'doc_id, page_no', 'chunk_no', 'len(text)', 4, 2200)} SELECT doc_id, page_no, chunk_no, batch_id FROM b")
def q_overlay_batches(spark, sf_dir):
    sized = chunks(spark, sf_dir).select("doc_id", "page_no", "chunk_no", F.char_length("text").alias("n"))
    return greedy_batches(sized, ["doc_id", "page_no"], ["chunk_no"], "n", DEFAULT.overlay_llm_items, DEFAULT.overlay_llm_chars).drop("n")


@query("token_batches", f"WITH RECURSIVE c AS (SELECT conv_id, turn, text FROM conversations), {greedy_sql('c', 'conv_id', 'turn', 'greatest(1, len(text) // 4)', None, 256)} SELECT conv_id, turn, n, batch_id FROM b")
def q_token_batches(spark, sf_dir):
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)).cast("long").alias("n"))
    return greedy_batches(sized, ["conv_id"], ["turn"], "n", None, 256, least=1)


@query("batch_limits_lookup", "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{m}', {i}, {c})" for e, m, i, c in DEFAULT.batch_limits) + ") t(engine, mode, max_items, max_chars)")
def q_limits(spark, sf_dir):
    return spark.createDataFrame(list(DEFAULT.batch_limits), "engine string, mode string, max_items int, max_chars int")


_MODELS = ["qwen2.5:3b-instruct", "gpt-oss:20b", "qwen3:30b", "gemma2:9b", "deepseek-r1:32b", "x", "QWEN3:4B"]


def _limit_sql(name: str) -> str:
    (a, b, c, d), (e, f, g, h) = LIMITS[name]
    return f"(CASE WHEN regexp_matches(lower(model), '^(gpt-oss|qwen3|deepseek-r1)') THEN least({a}, greatest({b}, trunc(n * {c}::DOUBLE)::BIGINT + {d})) ELSE least({e}, greatest({f}, trunc(n * {g}::DOUBLE)::BIGINT + {h})) END)::BIGINT AS {name}_limit"


_MODEL_ROWS = "(VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") m(model)"


def _with_models(spark, df):
    return df.select("*", F.explode(F.array(*[F.lit(m) for m in _MODELS])).alias("model"))


@query("prediction_limits", "SELECT doc_id, model, " + ", ".join(_limit_sql(n) for n in LIMITS) + f" FROM (SELECT doc_id, len(text) AS n FROM documents), {_MODEL_ROWS}")
def q_prediction_limits(spark, sf_dir):
    docs = _with_models(spark, table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n")))
    return docs.select("doc_id", "model", *[limit(n, F.col("n"), F.col("model")).alias(f"{n}_limit") for n in LIMITS])


@query("context_limits", f"SELECT doc_id, model, {_limit_sql('context')} FROM (SELECT doc_id, sum(len(l))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id), {_MODEL_ROWS}")
def q_context_limits(spark, sf_dir):
    totals = chunks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("n"))
    return _with_models(spark, totals).select("doc_id", "model", limit("context", F.col("n"), F.col("model")).alias("context_limit"))


@query("job_memory", f"""SELECT model, engine, CASE WHEN engine = 'nmt' THEN 6144 WHEN s IS NULL OR s <= 0 THEN 20480 WHEN s <= 4 THEN 8192 WHEN s <= 10 THEN 18432 WHEN s <= 14 THEN 24576 WHEN s <= 22 THEN 36864
  WHEN s <= 34 THEN 49152 ELSE 20480 END::BIGINT AS memory_mb FROM (SELECT model, engine, try_cast(regexp_extract(lower(model), '(\\d+(?:\\.\\d+)?)\\s*b', 1) AS DOUBLE) AS s FROM {_MODEL_ROWS}, (VALUES ('nmt'), ('ollama')) e(engine))""")
def q_job_memory(spark, sf_dir):
    models = spark.createDataFrame([(m, e) for m in _MODELS for e in ("nmt", "ollama")], "model string, engine string")
    return models.select("model", "engine", job_memory_mb(F.col("model"), F.col("engine")).alias("memory_mb"))


@query("cache_keys", """SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cache_key, min_by(text, doc_id) AS text, min(doc_id) AS first_doc, count(*) AS uses FROM documents GROUP BY 1""")
def q_cache_keys(spark, sf_dir):
    return dedupe_keys(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("cache_key", "text", F.col("first.doc_id").alias("first_doc"), "uses")


@query("dedupe_translate_fanout", f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_no, text, '[Copy only]' || chr(10) || trim(first_value(text) OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id, chunk_no)) AS translated_text FROM chunks""")
def q_fanout(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("doc_id", "chunk_no", "text")
    return translate_deduped(rows, lambda k: k.withColumn("translated_text", copy_expression(F.col("text"))), "text", ["doc_id", "chunk_no"])


@query("region_fanout_counts", """SELECT page_id, url, count(*) OVER (PARTITION BY split_part(url, '/', 3)) AS host_pages FROM pages""")
def q_host_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.element_at(F.split("url", "/"), 3).alias("host"))
    per = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return pages.join(per, "host").select("page_id", "url", "host_pages")


@query("translate_pages_copy", None)
def q_translate_pages(spark, sf_dir):
    return translate_pages(page_texts(spark, sf_dir), CopyTranslator(), "fast")


@query("page_reassembly", f"WITH {CHUNKS_SQL} SELECT doc_id, page_no, string_agg(trim(text), chr(10) || chr(10) ORDER BY chunk_no) AS translated_text FROM chunks GROUP BY doc_id, page_no")
def q_reassembly(spark, sf_dir):
    return assemble_pages(chunks(spark, sf_dir), ["doc_id", "page_no"], "chunk_no", "text")


@query("resilient_translate", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_no, CASE WHEN contains(text, 'th') AND len(text) <= 1200 THEN text ELSE replace(text, 'e', 'E') END AS translated_text, CASE WHEN contains(text, 'th') AND len(text) <= 1200 THEN 'source' ELSE 'ok' END AS status FROM chunks")
def q_resilient(spark, sf_dir):
    """A translator that fails for batches of more than two and for short texts with certain letters: halving reaches all others."""
    def fail(texts):
        if len(texts) > 2 or any("th" in t and len(t) <= 1200 for t in texts):
            raise TranslationError("refused")
        return [t.replace("e", "E") for t in texts]

    sized = chunks(spark, sf_dir).select("doc_id", "chunk_no", "text", F.char_length("text").alias("n"))
    batched = greedy_batches(sized, ["doc_id"], ["chunk_no"], "n", 24, 7000)
    return translate_batches(batched, ["doc_id"], FunctionTranslator(fail)).select("doc_id", "chunk_no", "translated_text", "status")


@query("copy_regions", f"WITH {CHUNKS_SQL} SELECT doc_id, page_no, chunk_no AS region_no, CASE WHEN chunk_no % 3 <> 0 THEN text ELSE '' END AS translated_text FROM chunks")
def q_copy_regions(spark, sf_dir):
    found = chunks(spark, sf_dir).select("doc_id", "page_no", F.col("chunk_no").alias("region_no"), "text", (F.col("chunk_no") % 3 != 0).alias("translatable"))
    return translate_regions(found, CopyTranslator()).select("doc_id", "page_no", "region_no", "translated_text")


@query("chunk_text", None)
def q_chunk_text(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("source_text"))
    return page_chunks(pages, "copy", "quality")


@query("page_chunks_nmt", f"WITH {PAGE_TEXTS_SQL} SELECT doc_id, page_no, 0 AS chunk_no, trim(source_text, ' ' || chr(10)) AS text FROM page_texts WHERE trim(source_text, ' ' || chr(10)) <> ''")
def q_page_chunks(spark, sf_dir):
    return page_chunks(page_texts(spark, sf_dir), "nmt")


_UNITS = r"""s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents)),
cut AS (SELECT doc_id, i, string_split(sentence, ' ') AS ws FROM s),
units AS (SELECT doc_id, i * 100000 + k AS no, ws[k * 62 + 1:k * 62 + 62] AS u FROM (SELECT *, unnest(range((len(ws) + 61) // 62)) AS k FROM cut))"""


@query("sentence_split_pack", f"WITH RECURSIVE {_UNITS}, {greedy_sql('units', 'doc_id', 'no', 'len(u)', None, 62)} SELECT doc_id, batch_id::INT AS piece_no, string_agg(array_to_string(u, ' '), ' ' ORDER BY rn) AS piece FROM b GROUP BY doc_id, batch_id")
def q_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(sentence_pieces(F.col("text"), 64)).alias("piece_no", "piece"))


@query("zip_fallback", """SELECT doc_id, CASE WHEN trim(t) = '' THEN s ELSE t END AS text FROM (SELECT doc_id, text AS s, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE 'T: ' || text END AS t FROM documents)""")
def q_zip(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("T: "), F.col("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("s"), F.array(t).alias("t"))
    return docs.select("doc_id", zip_fallback(F.col("s"), F.col("t"))[0].alias("text"))


@query("paginate_lines", f"""WITH RECURSIVE {CHUNKS_SQL}, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS rn, chunk_no % 5 = 4 AS blank FROM chunks),
p AS (SELECT doc_id, rn, 1 AS output_page, 500.0::DOUBLE AS y, blank FROM l WHERE rn = 1
 UNION ALL SELECT l.doc_id, l.rn, CASE WHEN p.y - 13.0::DOUBLE * CASE WHEN p.blank THEN 0.7::DOUBLE ELSE 1 END < 413 THEN p.output_page + 1 ELSE p.output_page END,
   CASE WHEN p.y - 13.0::DOUBLE * CASE WHEN p.blank THEN 0.7::DOUBLE ELSE 1 END < 413 THEN 500 ELSE p.y - 13.0::DOUBLE * CASE WHEN p.blank THEN 0.7::DOUBLE ELSE 1 END END, l.blank
 FROM p JOIN l ON l.doc_id = p.doc_id AND l.rn = p.rn + 1)
SELECT doc_id, output_page, count(*) AS n_lines, round(min(y), 4) AS last_y FROM p GROUP BY doc_id, output_page""")
def q_paginate(spark, sf_dir):
    lines = chunks(spark, sf_dir).select("doc_id", "chunk_no", F.when(F.col("chunk_no") % 5 != 4, F.col("text")).alias("line"))
    placed = paginate(lines, ["doc_id"], ["chunk_no"], "line", 500.0, 400.0, 13.0)
    return placed.groupBy("doc_id", "output_page").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.min("y"), 4).alias("last_y"))


@query("wrap_lines", None)
def q_wrap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(wrap_lines(F.col("text"), 9.2, 350.0)).alias("line_no", "line"))


@query("region_translate_page", f"""WITH {CHUNKS_SQL} SELECT doc_id, page_no, chunk_no AS region_no, CASE WHEN chunk_no % 4 = 3 THEN '' WHEN contains(text, 'ion') THEN text WHEN contains(text, 'and') THEN replace(text, 'e', '3') ELSE replace(text, 'e', 'E') END AS translated_text FROM chunks""")
def q_region_translate(spark, sf_dir):
    """Page by page as structured batches: some regions are refused so and translated plain, some are refused always, some come back empty."""

    class Picky(FunctionTranslator):
        def translate_batch_structured(self, texts):
            if any("and" in t and "ion" not in t for t in texts):
                raise TranslationError("no structured reply")
            return ["" if "ion" in t else t.replace("e", "E") for t in texts]

    found = chunks(spark, sf_dir).select("doc_id", "page_no", F.col("chunk_no").alias("region_no"), "text", (F.col("chunk_no") % 4 != 3).alias("translatable"))
    plain = Picky(lambda texts: [t.replace("e", "3") for t in texts])
    return translate_regions(found, plain, "page").select("doc_id", "page_no", "region_no", "translated_text")


@query("batch_char_totals", f"WITH RECURSIVE {CHUNKS_SQL}, {greedy_sql('chunks', 'doc_id', 'chunk_no', 'len(text)', 16, 4800)} SELECT doc_id, batch_id, sum(n)::BIGINT AS n_chars FROM b GROUP BY doc_id, batch_id")
def q_batch_totals(spark, sf_dir):
    items, chars = batch_limits("copy", "quality")
    sized = chunks(spark, sf_dir).select("doc_id", "chunk_no", F.char_length("text").cast("long").alias("n"))
    return greedy_batches(sized, ["doc_id"], ["chunk_no"], "n", items, chars).groupBy("doc_id", "batch_id").agg(F.sum("n").alias("n_chars"))


@query("char_totals", "SELECT doc_id, sum(len(trim(regexp_replace(text, '\\s+', ' ', 'g'))))::BIGINT AS n_chars FROM documents GROUP BY doc_id")
def q_char_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.sum(F.char_length(squeeze(F.col("text")))).alias("n_chars"))
