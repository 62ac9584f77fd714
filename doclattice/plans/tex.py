"""TeX sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import has_document_body, has_placeholder_artifact, is_unsafe, should_translate_tex
from ..operators import tex as X
from ..operators.translate import FunctionTranslator, TranslationError
from ..sources.testdata import TEX_FILES_SQL, table, tex_files
from .registry import query

_WORTH = r"(len(regexp_extract_all({t}, '[A-Za-z]')) >= 3 AND len(regexp_extract_all({t}, '\\[a-zA-Z@]+')) < greatest(6, len(regexp_extract_all({t}, '[A-Za-z]')) // 8))"
# a text of the plain kind, for which neither back-references nor environments matter
_RICH = r"""rich AS (SELECT doc_id, replace(text, '$', '') || ' see $x_' || doc_id || '$ and \cite{a' || doc_id || '} or \textbf{b} \% end' AS t FROM documents)"""
_SIMPLE = r"(\$[^$]*\$)|(\\[a-zA-Z@]+\*?(?:\s*\[[^\[\]]*\])?(?:\s*\{[^{}]*\})*)|(\\.)"


def _rich(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    t = F.concat(F.replace("text", F.lit("$"), F.lit("")), F.lit(" see $x_"), n, F.lit("$ and \\cite{a"), n, F.lit("} or \\textbf{b} \\% end"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


@query("tex_protect", rf"""WITH {_RICH}, s AS (SELECT doc_id, string_split_regex(t, '{_SIMPLE}') AS p, regexp_extract_all(t, '{_SIMPLE}') AS m FROM rich)
SELECT doc_id, list_reduce(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN p[1] ELSE '__DOCLATTICE_TEX_' || (i - 2) || '__' || p[i] END), lambda a, b: a || b) AS protected, array_to_string(m, chr(10)) AS placeholders FROM s""")
def q_protect(spark, sf_dir):
    found = _rich(spark, sf_dir).select("doc_id", X.protect_fragments(F.col("t")).alias("f"))
    return found.select("doc_id", "f.protected", F.array_join("f.placeholders", "\n").alias("placeholders"))


@query("tex_restore", rf"""WITH {_RICH} SELECT doc_id, replace(t, ' see $x_' || doc_id || '$ and', ' SEE$x_' || doc_id || '$and') AS t FROM rich""")
def q_restore(spark, sf_dir):
    """Markers come back in another spelling: lower case with a blank, which the tolerant form takes with the blanks around it."""
    found = _rich(spark, sf_dir).select("doc_id", X.protect_fragments(F.col("t")).alias("f"))
    spelled = F.regexp_replace("f.protected", r" see __DOCLATTICE_TEX_(\d+)__", " SEE doclattice tex $1")
    return found.select("doc_id", X.restore_fragments(spelled, F.col("f.placeholders")).alias("t"))


@query("tex_should_translate", f"WITH {TEX_FILES_SQL} SELECT project_id, path, {_WORTH.format(t='content')} AS worth FROM tex_files")
def q_worth(spark, sf_dir):
    return tex_files(spark, sf_dir).select("project_id", "path", should_translate_tex(F.col("content")).alias("worth"))


@query("tex_unsafe", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN doc_id % 8 = 1 WHEN doc_id % 4 = 2 THEN false ELSE regexp_matches(out, '\\[a-zA-Z@]+|[$&]') END AS unsafe
FROM (SELECT doc_id, text || CASE WHEN doc_id % 8 IN (1, 3) THEN ' __x $' ELSE '' END AS out FROM documents)""")
def q_unsafe(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, F.lit("{\\bf a}")).when(n % 4 == 2, F.lit("a & b")).otherwise(F.lit("plain words"))
    held = F.when(n % 4 == 1, F.array(F.lit("$x$"))).otherwise(F.array().cast("array<string>"))
    out = F.concat("text", F.when(n % 8 == 1, " __x $").when(n % 8 == 3, " __x $").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", is_unsafe(raw, held, out, "DOCLATTICE").alias("unsafe"))


@query("tex_artifacts", r"""SELECT doc_id, regexp_matches(out, '(?i)__|TEX[\s_-]*\d+|DOCLATTICE|doclatticecomment') AS artifact FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' vertex 0' WHEN 1 THEN '' ELSE ' a__b' END AS out FROM documents)""")
def q_artifacts(spark, sf_dir):
    n = F.col("doc_id") % 3
    out = F.concat("text", F.when(n == 0, " vertex 0").when(n == 1, "").otherwise(" a__b"))
    return table(spark, sf_dir, "documents").select("doc_id", has_placeholder_artifact(out, "DOCLATTICE").alias("artifact"))


_COMMENTED = r"replace(replace(text, '%', ''), ' th', ' \% % note th')"


@query("tex_comments", rf"""SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' th')))::INT AS n_comments, {_COMMENTED} AS restored FROM documents""")
def q_comments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit("%"), F.lit("")), F.lit(" th"), F.lit(" \\% % note th")).alias("t"))
    hidden = docs.select("doc_id", X.protect_comments(F.col("t")).alias("c"))
    return hidden.select("doc_id", F.size(F.split("c.text", "\n")).alias("n_lines"), F.size("c.comments").alias("n_comments"), X.restore_comments(F.col("c.text"), F.col("c.comments")).alias("restored"))


_BREAK = r"(&|\\\\(?:\[[^\]]*\])?|\\(?:toprule|midrule|bottomrule|hline)\b)"
_TABLE = r"replace(text, ' ', ' & ') || ' \\[2pt] \hline ' || text[1:20]"


@query("tex_cells", rf"""WITH c AS (SELECT doc_id, string_split_regex(t, '{_BREAK}') AS cells, regexp_extract_all(t, '{_BREAK}') AS breaks FROM (SELECT doc_id, {_TABLE} AS t FROM documents))
SELECT doc_id, 2 * i AS no, cells[i + 1] AS part, true AS is_cell FROM (SELECT doc_id, cells, unnest(range(len(cells))) AS i FROM c) UNION ALL
SELECT doc_id, 2 * i + 1, breaks[i + 1], false FROM (SELECT doc_id, breaks, unnest(range(len(breaks))) AS i FROM c)""")
def q_cells(spark, sf_dir):
    t = F.concat(F.replace("text", F.lit(" "), F.lit(" & ")), F.lit(" \\\\[2pt] \\hline "), F.substring("text", 1, 20))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.table_cells(t)).alias("no", "c")).select("doc_id", F.col("no").cast("long").alias("no"), "c.*")


@query("main_tex", f"WITH {TEX_FILES_SQL} SELECT project_id, path FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY NOT contains(content, '\\documentclass'), NOT contains(content, '\\begin{{document}}'), len(string_split(path, '/')), path) AS n FROM tex_files) WHERE n = 1")
def q_main(spark, sf_dir):
    return X.main_file(tex_files(spark, sf_dir)).select("project_id", "path")


@query("tex_document_body", f"WITH {TEX_FILES_SQL} SELECT project_id, path, contains(content, '\\begin{{document}}') AS has_body, CASE WHEN contains(content, '\\begin{{document}}') THEN split_part(split_part(content, '\\begin{{document}}', 2), '\\end{{document}}', 1) ELSE content END AS body FROM tex_files")
def q_body(spark, sf_dir):
    return tex_files(spark, sf_dir).select("project_id", "path", has_document_body(F.col("content")).alias("has_body"), X.body_of(F.col("content")).alias("body"))


@query("tex_japanese_support", f"WITH {TEX_FILES_SQL} SELECT project_id, path, CASE WHEN path = 'main.tex' THEN replace(content, '\\begin{{document}}', chr(10) || chr(10) || '\\usepackage{{luatexja}}' || chr(10) || '\\usepackage[ipa]{{luatexja-preset}}' || chr(10) || chr(10) || '\\begin{{document}}') ELSE content END AS content FROM tex_files")
def q_support(spark, sf_dir):
    return tex_files(spark, sf_dir).select("project_id", "path", X.add_japanese_support(F.col("content"), X.engine_or_default(F.lit(" pdfTeX "))).alias("content"))


# files whose texts hold none of TeX's own characters, so that SQL can say what is planned
_PLAIN_TEX = "WITH plain AS (SELECT doc_id, translate(text, '\\$%{}&~#_^', '') AS text FROM documents), " + TEX_FILES_SQL.replace("FROM documents", "FROM plain")
_WORDS = "string_split(replace(text, chr(10), ' '), ' ')"
_PARTS = rf"""{_PLAIN_TEX}, parts AS (
  SELECT doc_id AS project_id, 'main.tex' AS path, 0 AS g, 0 AS k, array_to_string({_WORDS}[1:5], ' ') AS raw FROM plain
  UNION ALL SELECT doc_id, 'main.tex', 1, unnest(range(len(ls))), unnest(ls) FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM plain)
  UNION ALL SELECT doc_id, 'main.tex', 2, 0, 'We see $x_1$ and \cite{{a}} here. \doclatticecomment{{0}}' FROM plain
  UNION ALL SELECT doc_id, 'main.tex', 3, unnest(range(len(ws))), trim(unnest(ws) || ' cell') FROM (SELECT doc_id, {_WORDS}[1:3] AS ws FROM plain)
  UNION ALL SELECT doc_id, 'sub/part.tex', 1, unnest(range(len(ps))), unnest(ps) FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS ps FROM plain)),
worth AS (SELECT * FROM parts WHERE len(regexp_extract_all(raw, '[A-Za-z]')) >= 3)"""


def _plain_tex(spark, sf_dir):
    return tex_files(spark, sf_dir, F.translate("text", "\\$%{}&~#_^", ""))


@query("tex_plan_segments", rf"""{_PARTS} SELECT project_id, path, (row_number() OVER (PARTITION BY project_id, path ORDER BY g, k) - 1)::INT AS seg_no, raw,
  CASE WHEN g = 2 THEN 'We see __DOCLATTICE_TEX_0__ and __DOCLATTICE_TEX_1__ here. __DOCLATTICE_TEX_2__' ELSE raw END AS protected,
  CASE WHEN g = 2 THEN '$x_1$' || chr(10) || '\cite{{a}}' || chr(10) || '\doclatticecomment{{0}}' ELSE '' END AS placeholders FROM worth""")
def q_plan(spark, sf_dir):
    return X.file_segments(X.plan_files(_plain_tex(spark, sf_dir))).withColumn("placeholders", F.array_join("placeholders", "\n"))


_SAID = "CASE WHEN len(regexp_extract_all({0}, '[A-Za-z]')) >= 3 AND NOT contains({0}, 'secret') THEN replace({0}, 'e', 'E') ELSE {0} END"


@query("tex_translate", rf"""{_PLAIN_TEX} SELECT doc_id AS project_id, 'main.tex' AS path, '\documentclass{{article}}' || chr(10) || '\begin{{document}}' || chr(10) || '\section{{' ||
    {_SAID.format(f"array_to_string({_WORDS}[1:5], ' ')")} || '}}' || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_SAID.format('x')}), chr(10) || chr(10)) || chr(10) || chr(10) ||
    'We see $x_1$ and \cite{{a}} here. % a note' || chr(10) || chr(10) || '\begin{{tabular}}{{lll}}' || chr(10) ||
    array_to_string(list_transform({_WORDS}[1:3], lambda x: {_SAID.format("(x || ' cell')")}), ' & ') || ' \\' || chr(10) || '\end{{tabular}}' || chr(10) || '\end{{document}}' || chr(10) AS content FROM plain
  UNION ALL SELECT doc_id, 'sub/part.tex', list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda i: {_SAID.format('ps[i]')} || coalesce(gaps[i], ''))), lambda a, b: a || b)
  FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS ps, regexp_extract_all(text, '\n\s*\n') AS gaps FROM plain)""")
def q_translate(spark, sf_dir):
    """A translator that takes three segments at most and refuses some: halving reaches all others, and what is refused stays."""

    def shout(texts):
        if len(texts) > 3 or any("secret" in t for t in texts):
            raise TranslationError("refused")
        return [t.replace("e", "E") for t in texts]

    return X.translate_files(_plain_tex(spark, sf_dir), FunctionTranslator(shout))


@query("tex_file_list", f"WITH {TEX_FILES_SQL} SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY path) - 1)::INT AS no, path FROM tex_files")
def q_list(spark, sf_dir):
    return X.file_list(tex_files(spark, sf_dir))


@query("tex_round_trip", f"WITH {TEX_FILES_SQL} SELECT project_id, path, content FROM tex_files")
def q_round_trip(spark, sf_dir):
    """A translator that returns its input: every file comes back as it was."""
    planned = X.plan_files(tex_files(spark, sf_dir))
    echoed = X.accept_translations(X.file_segments(planned).withColumn("translated_text", F.col("protected")))
    return X.assemble_files(planned, echoed)
