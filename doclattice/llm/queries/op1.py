"""Query op1_secret_scan and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..secrets import scan_secrets
from ..shared import read_table

NAME = "op1_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    said = F.expr("array_join(transform(spans, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.stop as string))), ',')")
    n = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said, 256).alias("base_sha256"), said.alias("spans"), "n_live", "n_shared", "n_example", "max_owners", "max_repos")


_A = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", _A, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]{24,}", 24)]
_P = ["'" + p.replace("'", "''") + "'" for _, p, _ in _KINDS]
_EACH = "\nUNION ALL\n".join(
    f"""SELECT row, doc_id, owner, {i} AS no, '{kind}' AS kind, m[j] AS m, {f"regexp_extract(m[j], {_P[i]}, 2)" if i == 0 else "m[j]"} AS v,
  list_sum(list_transform(p[1:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: len(x))), 0) AS start
FROM (SELECT row, doc_id, owner, regexp_extract_all(t, {_P[i]}) AS m, string_split_regex(t, {_P[i]}) AS p, unnest(range(1, len(regexp_extract_all(t, {_P[i]})) + 1)) AS j FROM docs)"""
    for i, (kind, _, _) in enumerate(_KINDS)
)

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '?') AS owner, coalesce(text, '') AS t FROM documents),
found AS ({_EACH}),
each AS (SELECT *, start + len(m) AS stop FROM found WHERE len(v) >= CASE no WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
spread AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repos, len(list_distinct(string_split(v, ''))) >= 8 AS varied FROM each GROUP BY v),
judged AS (SELECT row,
  count(*) FILTER (owners = 1 AND varied) AS n_live, count(*) FILTER (owners >= 3) AS n_example,
  count(*) FILTER (NOT (owners = 1 AND varied) AND owners < 3) AS n_shared, max(owners) AS max_owners, max(repos) AS max_repos,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans
  FROM each JOIN spread USING (v) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared,
  coalesce(n_example, 0)::BIGINT AS n_example, coalesce(max_owners, 0)::BIGINT AS max_owners, coalesce(max_repos, 0)::BIGINT AS max_repos
FROM docs LEFT JOIN judged USING (row)
"""
