"""Cleaning, repair and reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import system as S
from ..sources.testdata import CHUNKS_SQL, chunks, table
from .registry import query

_HYPHENS = "replace(replace(text, 'ion ', 'ion-' || chr(10)), '. ', '.' || chr(10) || chr(10) || chr(10) || '  ')"


def _hyphenated(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit("ion "), F.lit("ion-\n")), F.lit(". "), F.lit(".\n\n\n  "))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


# a fold over lines as lists: the last line joined, a blank run kept once, or a new line
@query("clean_text", f"""WITH l AS (SELECT doc_id, list_transform(string_split({_HYPHENS}, chr(10)), lambda x: [trim(regexp_replace(x, '\\s+', ' ', 'g'))]) AS ls FROM documents),
f AS (SELECT doc_id, list_reduce(ls, lambda acc, x: CASE
  WHEN x[1] = '' THEN CASE WHEN acc[-1] = '' THEN acc ELSE list_concat(acc, x) END
  WHEN ends_with(acc[-1], '-') AND x[1][1] = lower(x[1][1]) AND x[1][1] <> upper(x[1][1]) THEN list_concat(acc[1:-2], [acc[-1][1:len(acc[-1]) - 1] || x[1]])
  ELSE list_concat(acc, x) END) AS ls FROM l)
SELECT doc_id, trim(array_to_string(ls, chr(10)), ' ' || chr(10)) AS text FROM f""")
def q_clean(spark, sf_dir):
    return _hyphenated(spark, sf_dir).select("doc_id", T.clean_lines(F.col("text")).alias("text"))


_BLOCKS = "string_split(array_to_string(list_concat(ls, ls[1:3]), chr(10) || chr(10)), chr(10) || chr(10))"


@query("dedupe_recent_blocks", f"""WITH b AS (SELECT doc_id, list_transform(list_filter({_BLOCKS}, lambda x: trim(x) <> ''), lambda x: [trim(x)]) AS bs FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT doc_id, list_reduce(bs, lambda acc, x: CASE WHEN len(list_filter(acc[greatest(1, len(acc) - 5):], lambda y: replace(y, ' ', '') = replace(x[1], ' ', ''))) > 0 THEN acc ELSE list_concat(acc, x) END) AS bs FROM b)
SELECT doc_id, len(bs)::INT AS n_blocks, array_to_string(bs, chr(10) || chr(10)) AS text FROM f""")
def q_blocks(spark, sf_dir):
    ls = F.split("text", "\n")
    text = F.array_join(F.concat(ls, F.slice(ls, 1, 3)), "\n\n")
    kept = table(spark, sf_dir, "documents").select("doc_id", T.dedupe_recent_blocks(text).alias("text"))
    return kept.select("doc_id", F.size(F.split("text", "\n\n")).alias("n_blocks"), "text")


@query("nfkc_math", "SELECT doc_id, '1/2 L - fi ' || translate(text, '−–—∕⁄∗⋅∙⟨⟩', '---//*··<>') AS text FROM documents")
def q_math(spark, sf_dir):
    odd = F.concat(F.lit("½ 𝓛 − ﬁ "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_math(odd).alias("text"))


@query("math_symbols", "SELECT doc_id, translate(replace(text, 'e', '−'), '−–—∕⁄∗⋅∙⟨⟩', '---//*··<>') AS text FROM documents")
def q_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_math(F.replace("text", F.lit("e"), F.lit("−"))).alias("text"))


@query("collapse_runs", None)
def q_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_runs(F.concat(F.lit("aaaaaaaa 1111111 "), F.col("text"))).alias("text"))


@query("normalize_ja", None)
def q_ja(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_translation(F.concat(F.lit("stable Figure 1 "), F.col("text"))).alias("text"))


_TERMS = "text"
for _old, _new in T.TERMS:
    _TERMS = f"replace({_TERMS}, '{_old}', '{_new}')"


@query("replace_terms", f"SELECT doc_id, {_TERMS} AS text FROM (SELECT doc_id, 'A stable Table and Figure ' || replace(text, 'the', 'figure') AS text FROM documents)")
def q_terms(spark, sf_dir):
    text = F.concat(F.lit("A stable Table and Figure "), F.replace("text", F.lit("the"), F.lit("figure")))
    return table(spark, sf_dir, "documents").select("doc_id", T.replace_terms(text).alias("text"))


@query("squeeze_keys", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key, regexp_replace(text, '\\s+', '', 'g') AS compact FROM documents")
def q_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("key"), T.compact(F.col("text")).alias("compact"))


@query("clean_translations", None)
def q_clean_translation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_translation(F.col("text")).alias("text"))


@query("overlay_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def q_overlay(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_overlay(F.col("text")).alias("text"))


def _replies(spark, sf_dir):
    w = F.to_json(F.struct(F.array("text", F.lit("b")).alias("translations")))
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), w, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), w, F.lit(" done")))
    return table(spark, sf_dir, "documents").select("doc_id", fenced.alias("content"))


_W = "to_json({'translations': [text, 'b']})::VARCHAR"


@query("fence_strip", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN w ELSE 'Here: ' || w || ' done' END AS content FROM (SELECT doc_id, {_W} AS w FROM documents)")
def q_fence(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", T.strip_fence(T.strip(F.col("content"))).alias("content"))


@query("llm_reply_parse", "SELECT doc_id, trim(text, ' ' || chr(10)) AS a, 'b' AS b FROM documents")
def q_reply(spark, sf_dir):
    parsed = _replies(spark, sf_dir).select("doc_id", T.parse_reply(F.col("content"), F.lit(2)).alias("t"))
    return parsed.select("doc_id", F.col("t")[0].alias("a"), F.col("t")[1].alias("b"))


@query("json_candidates", f"""WITH r AS (SELECT doc_id, {_W} AS w FROM documents)
SELECT doc_id, 0 AS no, CASE WHEN doc_id % 2 = 0 THEN w ELSE 'Here: ' || w || ' done' END AS candidate FROM r
UNION ALL SELECT doc_id, 1, w[17:len(w) - 1] FROM r UNION ALL SELECT doc_id, 2, w FROM r""")
def q_candidates(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", F.posexplode(T.json_candidates(T.strip_fence(F.col("content")))).alias("no", "candidate"))


@query("error_heads", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_no, text[1:160] AS short, text[1:240] AS long FROM chunks")
def q_heads(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_no", T.head(F.col("text"), 160).alias("short"), T.head(F.col("text"), 240).alias("long"))


@query("tail_lines", "SELECT doc_id, array_to_string(ls[greatest(1, len(ls) - 4):], chr(10)) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def q_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.last_lines(F.col("text"), 5).alias("tail"))


@query("reply_content", "SELECT conv_id, turn, trim(text) AS content, CASE WHEN turn % 2 = 0 THEN 'ended by: stop' ELSE '' END AS hint FROM conversations")
def q_content(spark, sf_dir):
    reason = F.when(F.col("turn") % 2 == 0, "stop")
    body = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), reason.alias("done_reason")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.message_content(body).alias("content"), S.empty_reply_hint(body).alias("hint"))


_SHAPES = [
    '["# a", "b"]', '{"translated": ["# a", "b"]}', '{"items": [], "results": [{"translation": "# a"}, {"ja": "", "text": "b"}]}', '{"1": "b", "0": "# a", "10": ""}',
    '{"2": "b", "1": "# a"}', '{"output": "# a"}', '["# a"]', '["# a", ""]', '["# a", 7]', "no json", '{"text": ["# a", {"ja": " b "}]}', "Here [\"# a\", \"b\"] it is",
]
_SAID = ["a", "a", "a", None, "a", None, None, None, None, None, "a", "a"]


@query("reply_shapes", f"""SELECT doc_id, i AS shape, CASE WHEN ok THEN doc_id || ' a' END AS a, CASE WHEN ok THEN 'b' END AS b
FROM documents, (VALUES {", ".join(f"({i}, {'true' if x else 'false'})" for i, x in enumerate(_SAID))}) s(i, ok)""")
def q_shapes(spark, sf_dir):
    """All shapes that a reply may have, and some that don't count."""
    shapes = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in _SHAPES])).alias("shape", "content"))
    parsed = shapes.select("doc_id", "shape", T.parse_reply(F.replace("content", F.lit("#"), F.col("doc_id").cast("string")), F.lit(2)).alias("t"))
    return parsed.select("doc_id", "shape", F.col("t")[0].alias("a"), F.col("t")[1].alias("b"))
