"""Host metrics and service replies as text, read with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_int(c: Column) -> Column:
    """The first run of digits, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("long"), F.lit(0)).cast("long")


def gpu_samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name, total, used, free, utilisation`` lines; lines with another number of fields go."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    rows = lines.select(parts.alias("p")).where("size(p) = 5")
    names = ["memory_total_mb", "memory_used_mb", "memory_free_mb", "utilization_percent"]
    return rows.select(F.col("p")[0].alias("name"), *[parse_int(F.col("p")[i + 1]).alias(n) for i, n in enumerate(names)])


def system_memory(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row from ``key: number kB`` lines, or none without a positive total and free memory."""
    kv = lines.where(F.col(line).contains(":")).select(F.split(line, ":", 2).alias("kv")).select(F.col("kv")[0].alias("k"), F.nullif(F.regexp_extract(F.col("kv")[1], r"\d+", 0), F.lit("")).cast("long").alias("v"))
    of = lambda key: F.max(F.when(F.col("k") == key, F.col("v")))
    one = kv.agg(of("MemTotal").alias("t"), F.coalesce(of("MemAvailable"), of("MemFree")).alias("a")).where("t > 0 and a > 0")
    total, free = F.floor(F.col("t") / 1024), F.floor(F.col("a") / 1024)
    used = F.greatest(F.lit(0), total - free)
    gb = lambda mb: F.bround(mb / 1024, 2)
    return one.select(
        total.alias("memory_total_mb"), gb(total).alias("memory_total_gb"), free.alias("memory_available_mb"), gb(free).alias("memory_available_gb"), used.alias("memory_used_mb"), gb(used).alias("memory_used_gb")
    )


def installed_models(replies: DataFrame, body: str = "value") -> DataFrame:
    """Distinct names in ``{"models": [{"name": ..}]}`` replies; anything else gives none."""
    parsed = F.from_json(body, "models array<struct<name:string>>")
    return replies.select(F.explode(parsed["models"]).alias("m")).select("m.name").where("name is not null and name <> ''").distinct()


def service_status(replies: DataFrame, body: str = "value", keys: list[str] | None = None) -> DataFrame:
    """``status, ready`` of the model service, or that it is unavailable."""
    parsed = F.from_json(body, "status string, ready boolean")
    return replies.select(*(keys or []), F.coalesce(parsed["status"], F.lit("unavailable")).alias("status"), F.coalesce(parsed["ready"], F.lit(False)).alias("ready"))


def source_type(name: Column) -> Column:
    """struct(kind, suffix) by the file's name; null for other files."""
    low = F.lower(name)
    suffix = F.nullif(F.regexp_extract(low, r"(\.pdf|\.tex|\.zip|\.tgz|\.tar\.gz|\.tar\.xz|\.tar\.bz2|\.tar)$", 1), F.lit(""))
    return F.when(suffix.isNotNull(), F.struct(F.when(suffix == ".pdf", "pdf").otherwise("tex").alias("kind"), suffix.alias("suffix")))


def safe_stem(name: Column) -> Column:
    """The name without folder and suffix; anything but letters, numbers, ``-`` and ``_`` becomes ``_``; ``paper`` if nothing is left."""
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.when(F.lower(base).rlike(r"\.tar\.(gz|xz|bz2)$"), F.regexp_replace(base, r"\.[^.]+\.[^.]+$", "")).otherwise(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")
    return F.when(safe == "", "paper").otherwise(safe)


def field_value(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def message_content(reply: Column) -> Column:
    """The trimmed text of a chat reply; empty where there is none."""
    return F.coalesce(F.trim(F.get_json_object(reply, "$.message.content")), F.lit(""))


def empty_reply_hint(reply: Column) -> Column:
    """Why a reply may be empty: how it ended, and whether only reasoning came back."""
    reason, thought = F.get_json_object(reply, "$.done_reason"), F.get_json_object(reply, "$.message.thinking")
    some = F.when(F.char_length(thought) > 0, F.format_string("only reasoning was returned (%d characters)", F.char_length(thought)))
    return F.concat_ws("; ", F.when(reason != "", F.concat(F.lit("ended by: "), reason)), some)


def last_lines(text: Column, n: int = 40) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (n - 1)), n), "\n")
