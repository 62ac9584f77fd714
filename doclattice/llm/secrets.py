"""Secret scan with corpus-wide ownership frequency [native: SQL functions only].

Every text is scanned once for three kinds of candidates. The candidates' hashes are then counted over
the whole corpus by distinct owners and distinct repositories: a value that many owners hold is a copied
example, a value that one owner holds and that looks random is reported as live-looking.

Defined cases: a null text counts as empty; a null owner or repository counts as one owner or repository
of its own; repeated rows are scanned and returned once each and count once as a repository; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: The kinds in their order, the patterns, and the least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]

SPAN = "array<struct<start:bigint,kind_no:int,stop:bigint,kind:string,value_hash:string>>"


def _spans(kind_no: int, text: str, hits: str) -> str:
    """SQL for the spans of one kind from the list of its matches.

    The text between matches comes from ``split`` by the same pattern, so a match starts after the
    lengths of all pieces and matches before it.
    """
    kind, pattern, group, least = KINDS[kind_no]
    lit = _quoted(pattern)
    value = f"regexp_extract(m, {lit}, {group})"
    placed = f"""aggregate(
        zip_with(slice(split({text}, {lit}, -1), 1, size({hits})), {hits}, (p, m) -> struct(p, m)),
        struct(0L as at, cast(array() as {SPAN}) as found),
        (acc, x) -> struct(
            acc.at + length(x.p) + length(x.m) as at,
            concat(acc.found, array(struct(
                acc.at + length(x.p) as start, {kind_no} as kind_no, acc.at + length(x.p) + length(x.m) as stop,
                '{kind}' as kind, x.m as value_hash))) as found),
        acc -> acc.found)"""
    kept = f"filter({placed}, s -> length({value.replace('(m,', '(s.value_hash,')}) >= {least})"
    hashed = f"""transform({kept}, s -> struct(s.start, s.kind_no, s.stop, s.kind,
        concat(sha2({value.replace('(m,', '(s.value_hash,')}, 256),
               if(size(array_distinct(split({value.replace('(m,', '(s.value_hash,')}, ''))) >= 8, '+', '-')) as value_hash))"""
    return f"if(size({hits}) = 0, cast(array() as {SPAN}), {hashed})"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_candidates(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns and ``spans``: per text all candidates by start, then kind, with end and value hash.

    ``value_hash`` is the SHA-256 of the secret itself with a sign: ``+`` where it has eight different
    characters or more. The hexadecimal kind is looked for by runs of 24 or more, which are the maximal runs of that length.
    """
    text = docs.select(*(keep or []), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    names = [c for c in text.columns if c != "_t"]
    hits = text.select("*", *[F.expr(f"regexp_extract_all(_t, {_quoted(p)}, 0)").alias(f"_h{i}") for i, (_, p, _, _) in enumerate(KINDS)])
    every = ", ".join(_spans(i, "_t", f"_h{i}") for i in range(len(KINDS)))
    return hits.select(*names, F.expr(f"sort_array(concat({every}))").alias("spans"))


def ownership(candidates: DataFrame, example_owners: int = 3) -> DataFrame:
    """``candidates(value_hash, owner, repo)`` -> per hash the distinct owners and repositories, and a verdict.

    Verdicts: ``example`` (at least ``example_owners`` owners), ``live`` (one owner and a varied value), else ``shared``.
    Counts go through partial aggregates by (hash, owner, repo) and (hash, owner), so that a hash held by a third of all rows stays spread.
    """
    by_repo = candidates.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("repos"))
    total = by_owner.groupBy("value_hash").agg(F.sum("uses").alias("uses"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when((F.col("owners") == 1) & F.col("value_hash").endswith("+"), "live").otherwise("shared")
    return total.withColumn("verdict", verdict)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = 3) -> DataFrame:
    """One row per input row: id, ``spans`` (array), counts by verdict, and the widest spread of a candidate."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))
    keep = [F.col(id_col).alias("id"), named(owner_col).alias("owner"), named(repo_col).alias("repo")]
    found = materialize(find_candidates(docs, text_col, keep).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = found.where("size(spans) > 0").select("row", "owner", "repo", F.explode("spans.value_hash").alias("value_hash"))
    spread = ownership(each, example_owners)
    use = each.groupBy("row", "value_hash").agg(F.count(F.lit(1)).alias("n"))
    judged = use.join(spread, "value_hash").groupBy("row").agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(f"n_{v}") for v in ("live", "shared", "example")],
        F.max("owners").alias("max_owners"), F.max("repos").alias("max_repos"),
    )
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_shared", "n_example", "max_owners", "max_repos")]
    return found.join(judged, "row", "left").select(F.col("id").alias(id_col), "spans", *counts)
