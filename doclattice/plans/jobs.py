"""Job control, memory, sources and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT, MODELS
from ..functions.limits import mb_to_gb
from ..operators import jobs as J
from ..sources import system as S
from ..sources.testdata import CHUNKS_SQL, JOB_EVENTS_SQL, chunks, job_events, table
from .registry import query

_LATEST = f"""{JOB_EVENTS_SQL}, latest AS (SELECT job_id, arg_max(state, seq) AS s, arg_max(ts, seq) AS ts, arg_max(percent, seq) FILTER (percent IS NOT NULL) AS p, count(*) AS n_events FROM job_events GROUP BY job_id),
jobs AS (SELECT job_id, CASE WHEN s = 'progress' THEN 'running' ELSE s END AS status, (CASE s WHEN 'complete' THEN 100 WHEN 'queued' THEN 1 ELSE greatest(2, coalesce(p, 2)) END)::BIGINT AS percent, CASE WHEN s IN ('complete', 'error') THEN ts END AS completed_at, n_events FROM latest)"""
_MODEL = "CASE job_id % 5 WHEN 0 THEN 'qwen3:30b' WHEN 1 THEN 'gpt-oss:20b' WHEN 2 THEN 'gemma2:9b' WHEN 3 THEN 'qwen2.5:3b' ELSE 'x' END"
_ENGINE = "CASE WHEN job_id % 4 = 0 THEN 'nmt' ELSE 'ollama' END"
_MB = f"CASE WHEN job_id % 4 = 0 THEN 6144 ELSE CASE job_id % 5 WHEN 0 THEN 49152 WHEN 1 THEN 36864 WHEN 2 THEN 18432 WHEN 3 THEN 8192 ELSE 20480 END END"


def _jobs(spark, sf_dir):
    n = F.col("job_id")
    model = F.when(n % 5 == 0, "qwen3:30b").when(n % 5 == 1, "gpt-oss:20b").when(n % 5 == 2, "gemma2:9b").when(n % 5 == 3, "qwen2.5:3b").otherwise("x")
    return J.latest_state(job_events(spark, sf_dir)).withColumn("model", model).withColumn("engine", F.when(n % 4 == 0, "nmt").otherwise("ollama"))


@query("job_state_latest", f"WITH {_LATEST} SELECT * FROM jobs")
def q_state(spark, sf_dir):
    return J.latest_state(job_events(spark, sf_dir))


@query("job_queue_position", f"""WITH {_LATEST} SELECT job_id, (row_number() OVER w)::INT AS position, count(*) OVER (PARTITION BY job_id % 4) AS queue_length,
  CASE WHEN row_number() OVER w = 1 THEN 'no memory' ELSE 'waiting: ' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY job_id % 4) END AS message FROM jobs WHERE status = 'queued' WINDOW w AS (PARTITION BY job_id % 4 ORDER BY job_id)""")
def q_queue(spark, sf_dir):
    queued = J.latest_state(job_events(spark, sf_dir)).where("status = 'queued'").withColumn("host", F.col("job_id") % 4)
    return J.queue_positions(queued, ["job_id"], ["host"], F.lit("no memory")).select("job_id", "position", "queue_length", "message")


@query("job_dispatch", f"""WITH RECURSIVE {_LATEST}, r AS (SELECT job_id, job_id % 8 AS host, status, job_id % 4 = 0 AS nmt, {_MB} AS mb, row_number() OVER (PARTITION BY job_id % 8 ORDER BY job_id) AS rn FROM jobs),
s AS (SELECT 0::BIGINT AS rn, host, NULL::BIGINT AS job_id, 0 AS running, 0 AS nmts, 0 AS used, false AS blocked, NULL::BOOLEAN AS started FROM (SELECT DISTINCT host FROM r)
 UNION ALL SELECT r.rn, r.host, r.job_id, s.running + CASE WHEN r.status = 'queued' AND NOT b THEN 1 ELSE 0 END, s.nmts + CASE WHEN r.status = 'queued' AND NOT b AND r.nmt THEN 1 ELSE 0 END,
   s.used + CASE WHEN r.status = 'queued' AND NOT b THEN r.mb ELSE 0 END, CASE WHEN r.status = 'queued' THEN b ELSE s.blocked END, r.status = 'queued' AND NOT b
 FROM s JOIN r ON r.host = s.host AND r.rn = s.rn + 1, LATERAL (SELECT s.blocked OR s.running >= 4 OR (r.nmt AND s.nmts >= 1) OR s.used + r.mb > 102400 AS b))
SELECT job_id, host, started FROM s WHERE rn > 0""")
def q_dispatch(spark, sf_dir):
    rows = _jobs(spark, sf_dir).withColumn("host", F.col("job_id") % 8)
    return J.dispatch(rows, ["job_id"], ["host"], 102400).select("job_id", "host", "started")


@query("job_admission", f"""WITH RECURSIVE {JOB_EVENTS_SQL}, a AS (SELECT job_id % 16 AS host, seq, state = 'queued' AS sub, row_number() OVER (PARTITION BY job_id % 16 ORDER BY seq) AS rn FROM job_events WHERE state IN ('queued', 'complete')),
s AS (SELECT host, seq, rn, sub, CASE WHEN sub THEN 1 ELSE 0 END AS open, CASE WHEN sub THEN true END AS accepted FROM a WHERE rn = 1
 UNION ALL SELECT a.host, a.seq, a.rn, a.sub, CASE WHEN a.sub THEN CASE WHEN s.open < 6 THEN s.open + 1 ELSE s.open END ELSE greatest(0, s.open - 1) END, CASE WHEN a.sub THEN s.open < 6 END FROM s JOIN a ON a.host = s.host AND a.rn = s.rn + 1)
SELECT host, seq, accepted FROM s WHERE sub""")
def q_admission(spark, sf_dir):
    arrivals = job_events(spark, sf_dir).where("state in ('queued', 'complete')").select((F.col("job_id") % 16).alias("host"), "seq", F.when(F.col("state") == "queued", "submit").otherwise("finish").alias("kind"))
    return J.admitted(arrivals, ["seq"], ["host"]).where("kind = 'submit'").select("host", "seq", "accepted")


@query("job_ttl_expire", f"WITH {_LATEST}, n AS (SELECT max(ts) AS now FROM events) SELECT job_id, status FROM jobs, n WHERE NOT coalesce(status IN ('complete', 'error') AND completed_at < now - INTERVAL 3600 SECOND, false)")
def q_ttl(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return J.expire(J.latest_state(job_events(spark, sf_dir)), F.lit(now)).select("job_id", "status")


@query("memory_control", f"""WITH {_LATEST}, g AS (SELECT 81920 * count(*) AS total, sum(1000 + (s_suppkey * 37) % 1000)::BIGINT AS used FROM supplier),
r AS (SELECT sum({_MB})::BIGINT AS reserved, count(*) AS running FROM (SELECT * FROM jobs WHERE status = 'running')), x AS (SELECT total::BIGINT AS total_mb, used AS used_mb, total - used AS free_mb, coalesce(reserved, 0)::BIGINT AS reserved_mb, running AS running_jobs FROM g, r)
SELECT total_mb, used_mb, free_mb, reserved_mb, running_jobs, least(102400, greatest(0, total_mb - 8192))::BIGINT AS budget_mb, least(total_mb, used_mb + reserved_mb)::BIGINT AS effective_used_mb, total_mb > 0 AS available,
  least(4, running_jobs + greatest(0, least(102400, greatest(0, total_mb - 8192)) - least(total_mb, used_mb + reserved_mb)) // 20480)::BIGINT AS "limit" FROM x""")
def q_memory(spark, sf_dir):
    used = 1000 + (F.col("s_suppkey") * 37) % 1000
    gpus = table(spark, sf_dir, "supplier").select(F.lit(81920).cast("long").alias("memory_total_mb"), used.cast("long").alias("memory_used_mb"), (81920 - used).cast("long").alias("memory_free_mb"))
    running = _jobs(spark, sf_dir).where("status = 'running'").withColumn("resource_reserved_mb", F.lit(0).cast("long"))
    return J.memory_control(gpus, running)


@query("gpu_totals", "SELECT sum(1000 + s_suppkey)::BIGINT AS total_mb, sum(s_suppkey)::BIGINT AS used_mb, count(*) AS gpus FROM supplier")
def q_gpus(spark, sf_dir):
    line = F.concat_ws(", ", F.lit("gpu"), F.concat((1000 + F.col("s_suppkey")).cast("string"), F.lit(" MiB")), F.col("s_suppkey").cast("string"), F.lit("1000"), F.lit("n/a"))
    bad = F.lit("no fields")
    lines = table(spark, sf_dir, "supplier").select(F.explode(F.array(line, bad)).alias("value"))
    return S.gpu_samples(lines).agg(F.sum("memory_total_mb").alias("total_mb"), F.sum("memory_used_mb").alias("used_mb"), F.count(F.lit(1)).alias("gpus"))


@query("system_memory", "SELECT 16014::BIGINT AS memory_total_mb, 15.64::DOUBLE AS memory_total_gb, 8007::BIGINT AS memory_available_mb, 7.82::DOUBLE AS memory_available_gb, 8007::BIGINT AS memory_used_mb, 7.82::DOUBLE AS memory_used_gb")
def q_system(spark, sf_dir):
    rows = [("MemTotal:       16399100 kB",), ("MemFree:         1000000 kB",), ("MemAvailable:    8199600 kB",), ("nonsense",)]
    return S.system_memory(spark.createDataFrame(rows, "value string"))


@query("progress_percent", f"""WITH {CHUNKS_SQL}, b AS (SELECT doc_id, chunk_no, sum(1) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS done, count(*) OVER (PARTITION BY doc_id) AS total FROM chunks)
SELECT doc_id, chunk_no, done::BIGINT AS done, total::BIGINT AS total, (8 + floor(done / total * 84))::INT AS percent FROM b""")
def q_progress(spark, sf_dir):
    ones = chunks(spark, sf_dir).select("doc_id", "chunk_no", F.lit(1).alias("n"))
    return J.running_progress(ones, ["doc_id"], ["chunk_no"], "n").drop("n")


@query("tex_progress", "SELECT event_id, 10 + trunc(80 * greatest(0.0, least(1.0, (trunc(value)::INT % 101 - 8) / 80)))::INT AS percent FROM events")
def q_tex_progress(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.tex_percent(F.col("value").cast("int") % 101, F.lit(10), F.lit(90)).alias("percent"))


@query("progress_clamp", "SELECT event_id, CASE WHEN event_type <> 'view' THEN greatest(0, least(100, trunc(value)::INT - 20)) END AS percent FROM events")
def q_clamp(spark, sf_dir):
    return J.progress_events(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value").cast("int") - 20).alias("percent")))


@query("public_jobs", f"WITH {_LATEST} SELECT job_id::VARCHAR AS job_id, status, percent, '' AS message, {_ENGINE} AS engine, {_MODEL} AS model, '/api/jobs/' || job_id || '/download' AS download_url FROM jobs")
def q_public(spark, sf_dir):
    return J.public_jobs(_jobs(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("string")).withColumn("message", F.lit(None).cast("string")))


@query("status_counts", f"WITH {_LATEST} SELECT count(*) FILTER (status = 'queued') AS queue_length, count(*) FILTER (status = 'running') AS running_jobs, count(*) AS jobs, 4 AS max_concurrent_jobs, 2 AS max_queued_jobs FROM jobs")
def q_status(spark, sf_dir):
    return J.status_counts(J.latest_state(job_events(spark, sf_dir)))


@query("recover_outputs", """SELECT md5(user_id::VARCHAR)[1:12] AS job_id, arg_max('out/f' || event_id || '_' || md5(user_id::VARCHAR)[1:12] || '_ja.pdf', event_id) AS path, max(event_id) AS modified FROM events WHERE event_id % 2 = 0 GROUP BY 1""")
def q_recover(spark, sf_dir):
    key = F.substring(F.md5(F.col("user_id").cast("string")), 1, 12)
    tail = F.when(F.col("event_id") % 2 == 0, "_ja.pdf").otherwise("_ja.txt")
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("out/f"), F.col("event_id").cast("string"), F.lit("_"), key, tail).alias("path"), F.col("event_id").alias("modified"))
    return J.recover_outputs(files)


_NAMES = ["a.PDF", "b.tar.gz", "c.gz", "dir/my paper (1).zip", "e.tex", "f.tgz", ".pdf", "é-ü_x.tar.xz"]


@query("source_types", """SELECT * FROM (VALUES ('a.PDF', 'pdf', '.pdf', 'a'), ('b.tar.gz', 'tex', '.tar.gz', 'b'), ('c.gz', NULL, NULL, 'c'), ('dir/my paper (1).zip', 'tex', '.zip', 'my_paper__1_'), ('e.tex', 'tex', '.tex', 'e'), ('f.tgz', 'tex', '.tgz', 'f'),
('.pdf', 'pdf', '.pdf', '_pdf'), ('é-ü_x.tar.xz', 'tex', '.tar.xz', 'é-ü_x')) t(name, kind, suffix, stem)""")
def q_types(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return names.select("name", S.source_type(F.col("name")).alias("t"), S.safe_stem(F.col("name")).alias("stem")).select("name", "t.kind", "t.suffix", "stem")


@query("request_validation", f"""SELECT 'f' || event_id || e AS name, CASE WHEN bytes > {DEFAULT.upload_mb * 1024 * 1024} THEN 'too large' WHEN e = '.doc' THEN 'type' WHEN event_type = 'error' THEN 'engine' WHEN e = '.pdf' AND event_type = 'view' AND NOT ready THEN 'not ready' END AS error,
  CASE e WHEN '.pdf' THEN 'pdf' WHEN '.zip' THEN 'tex' END AS source_type, CASE WHEN e = '.zip' THEN 'ollama' ELSE g END AS engine, CASE WHEN e = '.zip' THEN 'tex' ELSE 'fast' END AS layout
FROM (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.zip' ELSE '.doc' END AS e, (value * 2000000)::BIGINT AS bytes, event_id % 2 = 0 AS ready, CASE event_type WHEN 'error' THEN 'bad' WHEN 'view' THEN 'nmt' ELSE 'copy' END AS g FROM events)""")
def q_requests(spark, sf_dir):
    n, kind = F.col("event_id") % 3, F.col("event_type")
    suffix = F.when(n == 0, ".pdf").when(n == 1, ".zip").otherwise(".doc")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), F.col("event_id").cast("string"), suffix).alias("name"), F.round(F.col("value") * 2000000).cast("long").alias("bytes"),
        F.when(kind == "error", " BAD ").when(kind == "view", "nmt").otherwise("copy").alias("engine"), F.lit(None).cast("string").alias("layout"), (F.col("event_id") % 2 == 0).alias("nmt_ready"),
    )
    return J.validate_requests(rows)


@query("service_requests", """SELECT conv_id, (count(*) BETWEEN 1 AND 5 AND count(text) = count(*) AND sum(len(text)) <= 3000) AS accepted FROM conversations GROUP BY conv_id""")
def q_service(spark, sf_dir):
    from dataclasses import replace

    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts")).withColumn("body_bytes", F.lit(1000))
    return J.validate_service_requests(rows, replace(DEFAULT, service_texts=5, service_chars=3000)).select("conv_id", "accepted")


@query("catalog_options", """SELECT 'llm' AS engine, p_brand || '-' || p_partkey AS value, p_name AS label, p_partkey % 3 = 0 AS installed FROM part""")
def q_catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    value = F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))
    options = part.select(F.lit("llm").alias("engine"), value.alias("value"), F.col("p_name").alias("label"))
    replies = part.where("p_partkey % 3 = 0").select(F.to_json(F.struct(F.array(F.struct(value.alias("name")), F.struct(F.lit("").alias("name"))).alias("models"))).alias("value"))
    return J.catalog_options(options, S.installed_models(replies))


@query("nmt_running", f"WITH {_LATEST} SELECT count(*) AS nmt_running FROM jobs WHERE status = 'running' AND job_id % 4 = 0")
def q_nmt(spark, sf_dir):
    return J.running_jobs(_jobs(spark, sf_dir), "nmt").select(F.col("running").alias("nmt_running"))


@query("running_reservations", f"WITH {_LATEST} SELECT job_id, {_MB}::BIGINT AS reserved_mb FROM jobs WHERE status = 'running'")
def q_reserved(spark, sf_dir):
    return J.with_reservation(_jobs(spark, sf_dir).where("status = 'running'").withColumn("resource_reserved_mb", F.lit(None).cast("long"))).select("job_id", "reserved_mb")


@query("field_defaults", "SELECT conv_id, turn, CASE WHEN trim(role) = 'system' THEN 'nmt' ELSE role END AS value FROM conversations")
def q_fields(spark, sf_dir):
    value = F.when(F.col("role") == "system", "  ").otherwise(F.concat(F.lit(" "), F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.field_value(value, "nmt").alias("value"))


@query("wait_messages", f"WITH {_LATEST} SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'waiting for GPU memory' ELSE 'waiting: ' || n_events || ' of ' || job_id % 5 || ' places taken' END AS message FROM jobs WHERE status = 'queued'")
def q_wait_message(spark, sf_dir):
    queued = _jobs(spark, sf_dir).where("status = 'queued'")
    return queued.select("job_id", J.wait_message(F.col("n_events"), F.col("job_id") % 5).alias("message"))


@query("job_list", f"WITH {_LATEST} SELECT job_id, status, CASE WHEN job_id % 2 = 0 THEN 'paper-' || job_id || '.pdf' ELSE '' END AS filename, '' AS message, CASE WHEN job_id % 3 = 0 THEN 'tex' ELSE 'pdf' END AS source_type FROM jobs")
def q_job_list(spark, sf_dir):
    n = F.col("job_id")
    named = _jobs(spark, sf_dir).withColumn("filename", F.when(n % 2 == 0, F.format_string("paper-%d.pdf", n))).withColumn("message", F.lit(None).cast("string"))
    return J.job_list(named.withColumn("source_type", F.when(n % 3 == 0, "tex")))


@query("service_status", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'loading' ELSE 'unavailable' END AS status, turn % 3 = 0 AND turn % 2 = 0 AS ready FROM conversations")
def q_service_status(spark, sf_dir):
    turn = F.col("turn")
    body = F.when(turn % 3 == 0, F.to_json(F.struct(F.lit("loading").alias("status"), (turn % 2 == 0).alias("ready")))).when(turn % 3 == 1, "not json")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("value"))
    return S.service_status(rows, keys=["conv_id", "turn"])


@query("memory_gb", "SELECT s_suppkey, round_even(s_suppkey * 1536 / 1024, 2) AS gb FROM supplier")
def q_gb(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", mb_to_gb(F.col("s_suppkey") * 1536).alias("gb"))


_OPTIONS = "(VALUES " + ", ".join(f"('{e}', '{m}', {'true' if i == 0 else 'false'})" for e, models in MODELS.items() for i, m in enumerate(models)) + ") o(engine, value, is_default)"


@query("public_models", f"""WITH there AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'qwen3:30b' WHEN s_suppkey % 3 = 1 THEN 'gemma2:9b' ELSE 'own-' || s_suppkey END AS name FROM supplier),
m AS (SELECT engine, string_agg('{{"value":"' || value || '","is_default":' || is_default || ',"installed":' || (value IN (SELECT name FROM there)) || '}}', ',' ORDER BY value) AS models FROM {_OPTIONS} GROUP BY engine)
SELECT (SELECT string_agg(name, ',' ORDER BY name) FROM there) AS installed, '[' || string_agg('{{"engine":"' || engine || '","models":[' || models || ']}}', ',' ORDER BY engine) || ']' AS catalog FROM m""")
def q_public_models(spark, sf_dir):
    n = F.col("s_suppkey")
    name = F.when(n % 3 == 0, "qwen3:30b").when(n % 3 == 1, "gemma2:9b").otherwise(F.concat(F.lit("own-"), n.cast("string")))
    replies = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(F.struct(name.alias("name"))).alias("models"))).alias("value"))
    return J.public_models(J.model_options(spark), S.installed_models(replies)).select(F.array_join("installed", ",").alias("installed"), "catalog")
