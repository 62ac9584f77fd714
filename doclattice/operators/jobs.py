"""Job control as data: state by job, queue, admission, memory budget, expiry and progress."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, MODELS, Settings
from ..functions.limits import job_memory_mb

TERMINAL = ("complete", "error")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job decides its state; the last percent seen stays; terminal states set the time of completion."""
    last = F.max_by(F.struct("state", "ts"), "seq")
    percent = F.max_by(F.when(F.col("percent").isNotNull(), F.col("percent")), F.when(F.col("percent").isNotNull(), F.col("seq")))
    each = events.groupBy("job_id").agg(last.alias("l"), percent.alias("percent"), F.count(F.lit(1)).alias("n_events"))
    state = F.when(F.col("l.state") == "progress", "running").otherwise(F.col("l.state"))
    done = F.col("l.state").isin(*TERMINAL)
    shown = F.when(F.col("l.state") == "complete", 100).when(F.col("l.state") == "queued", 1).otherwise(F.greatest(F.lit(2), F.coalesce("percent", F.lit(2))))
    return each.select("job_id", state.alias("status"), shown.cast("long").alias("percent"), F.when(done, F.col("l.ts")).alias("completed_at"), "n_events")


def queue_positions(queued: DataFrame, order: list[str], partition: list[str], blocked: Column | None = None) -> DataFrame:
    """Adds ``position``, ``queue_length`` and ``message``; the head may show why it waits."""
    w = W.partitionBy(*partition)
    at, total = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    message = F.format_string("waiting: %d/%d", at, total)
    if blocked is not None:
        message = F.when((at == 1) & blocked.isNotNull(), blocked).otherwise(message)
    return queued.withColumn("position", at).withColumn("queue_length", total).withColumn("message", message)


def expire(jobs: DataFrame, now: Column, ttl_seconds: int = DEFAULT.job_ttl_seconds) -> DataFrame:
    """Jobs but those that ended longer ago than the time to live (60 s at least)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("completed_at").cast("timestamp"))
    gone = F.col("status").isin(*TERMINAL) & F.col("completed_at").isNotNull() & (age > max(60, ttl_seconds) * 1_000_000)
    return jobs.where(~F.coalesce(gone, F.lit(False)))


def with_reservation(jobs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``reserved_mb``: what the job holds, or the estimate where that is missing or not positive."""
    held = F.when(F.col("resource_reserved_mb") > 0, F.col("resource_reserved_mb"))
    return jobs.withColumn("reserved_mb", F.coalesce(held, job_memory_mb(F.col("model"), F.col("engine"), settings)))


def memory_control(gpus: DataFrame, running: DataFrame, system: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """One row: budget, use and how many jobs may run. Without GPU memory the host's counts; without either nothing is known."""
    g = gpus.agg(F.coalesce(F.sum("memory_total_mb"), F.lit(0)).alias("total"), F.coalesce(F.sum("memory_used_mb"), F.lit(0)).alias("used"), F.coalesce(F.sum("memory_free_mb"), F.lit(0)).alias("free"))
    r = with_reservation(running, settings).agg(F.coalesce(F.sum("reserved_mb"), F.lit(0)).alias("reserved"), F.count(F.lit(1)).alias("running"))
    s = (system if system is not None else gpus.limit(0).select(F.lit(0).alias("memory_total_mb"), F.lit(0).alias("memory_available_mb"))).agg(F.max("memory_total_mb").alias("s_total"), F.max("memory_available_mb").alias("s_free"))
    # three rows of one row each, joined on a constant
    one = g.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k").join(s.withColumn("k", F.lit(1)), "k")
    host = F.col("total") <= 0
    total = F.when(host, F.coalesce("s_total", F.lit(0))).otherwise(F.col("total"))
    free = F.when(host, F.coalesce("s_free", F.lit(0))).otherwise(F.col("free"))
    used = F.when(host, F.greatest(F.lit(0), total - free)).otherwise(F.col("used"))
    x = one.select(total.cast("long").alias("total_mb"), used.cast("long").alias("used_mb"), free.cast("long").alias("free_mb"), F.col("reserved").cast("long").alias("reserved_mb"), F.col("running").alias("running_jobs"))
    x = x.withColumn("budget_mb", F.least(F.lit(settings.memory_budget_mb), F.greatest(F.lit(0), F.col("total_mb") - settings.min_free_mb)).cast("long"))
    x = x.withColumn("effective_used_mb", F.least(F.col("total_mb"), F.col("used_mb") + F.col("reserved_mb")))
    slots = F.floor(F.greatest(F.lit(0), F.col("budget_mb") - F.col("effective_used_mb")) / max(1, settings.default_job_mb))
    return x.withColumn("available", F.col("total_mb") > 0).withColumn("limit", F.when(F.col("total_mb") > 0, F.least(F.lit(settings.max_running), F.col("running_jobs") + slots)).otherwise(settings.max_running).cast("long"))


def dispatch(requests: DataFrame, order: list[str], partition: list[str], budget_mb: int, used_mb: int = 0, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``started``: first come, first served with a blocking head, within each ``partition`` (a host).

    Entries that are no longer queued are passed over. A host's queue is one ordered stream by definition of the policy.
    """
    sized = requests.withColumn("_mb", job_memory_mb(F.col("model"), F.col("engine"), settings))

    def step(state: tuple[int, int, int, bool], status: str, engine: str, mb: int):
        running, nmt, used, blocked = state
        if status != "queued":
            return state, (False,)
        blocked = blocked or running >= settings.max_running or (engine == "nmt" and nmt >= settings.max_nmt_running) or used + mb > budget_mb
        if blocked:
            return (running, nmt, used, True), (False,)
        return (running + 1, nmt + (engine == "nmt"), used + mb, False), (True,)

    from .folds import ordered_fold

    return ordered_fold(sized, partition, order, ["status", "engine", "_mb"], "started boolean", lambda: (0, 0, used_mb, False), step).drop("_mb")


def admitted(arrivals: DataFrame, order: list[str], partition: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``accepted``: an arrival (``kind`` = submit) is refused while running and queued jobs fill the places; a ``finish`` frees one."""
    from .folds import ordered_fold

    most = settings.max_running + settings.max_queued

    def step(open_: int, kind: str):
        if kind == "submit":
            return (open_ + 1, (True,)) if open_ < most else (open_, (False,))
        return max(0, open_ - 1), (None,)

    return ordered_fold(arrivals, partition, order, ["kind"], "accepted boolean", lambda: 0, step)


def done_percent(done: Column, total: Column) -> Column:
    return 8 + F.floor(done / F.greatest(total, F.lit(1)) * 84).cast("int")


def tex_percent(percent: Column, base: Column, end: Column) -> Column:
    """A file's percent in its share of the whole project."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (percent - 8) / 80))
    return base + ((end - base) * share).cast("int")


def running_progress(batches: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """Adds ``done``, ``total`` and ``percent`` after each batch."""
    w = W.partitionBy(*keys)
    done = F.sum(size).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return batches.withColumn("done", done).withColumn("total", F.sum(size).over(w)).withColumn("percent", done_percent(F.col("done"), F.col("total")))


def progress_events(df: DataFrame) -> DataFrame:
    """Percent clamped to 0..100; other fields as they are."""
    return df.withColumn("percent", F.when(F.col("percent").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("percent")))))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """What clients see of a job, with defaults."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return jobs.select("job_id", d("status", "queued"), d("percent", 0), d("message", ""), d("engine", ""), d("model", ""), F.concat(F.lit("/api/jobs/"), F.col("job_id"), F.lit("/download")).alias("download_url"))


def recover_outputs(files: DataFrame) -> DataFrame:
    """``path, modified``: of each finished job (12 hexadecimal digits in the name) the newest output."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.withColumn("job_id", F.regexp_extract(name, r"_([0-9a-f]{12})_ja\.pdf$", 1)).where("job_id <> ''")
    return found.groupBy("job_id").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def status_counts(jobs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queue_length"), F.count_if(F.col("status") == "running").alias("running_jobs"), F.count(F.lit(1)).alias("jobs"),
        F.lit(settings.max_running).alias("max_concurrent_jobs"), F.lit(settings.max_queued).alias("max_queued_jobs"),
    )


def running_jobs(jobs: DataFrame, engine: str) -> DataFrame:
    """How many jobs of an engine run: one row, ``running``."""
    return jobs.where((F.col("status") == "running") & (F.col("engine") == engine)).agg(F.count(F.lit(1)).alias("running"))


def wait_message(running: Column, limit: Column) -> Column:
    """What a waiting job is told."""
    return F.when(limit <= 0, "waiting for GPU memory").otherwise(F.format_string("waiting: %d of %d places taken", running, limit))


def job_list(jobs: DataFrame) -> DataFrame:
    """The jobs of a status snapshot, one row each: what clients may see, with defaults."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return jobs.select("job_id", d("status", ""), d("filename", ""), d("message", ""), d("source_type", "pdf"))


def validate_requests(requests: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Uploads to validated requests: ``error`` says why not; TeX always goes to the free-text engine."""
    name = F.lower(F.col("name"))
    kind = F.when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(tex|zip|tar|tgz)$|\.tar\.(gz|xz|bz2)$"), "tex")
    engine = F.lower(F.trim(F.coalesce(F.col("engine"), F.lit("nmt"))))
    error = (
        F.when(F.col("bytes") > settings.upload_mb * 1024 * 1024, "too large").when(kind.isNull(), "type").when(~engine.isin("nmt", "ollama", "copy"), "engine")
        .when((kind == "pdf") & (engine == "nmt") & ~F.coalesce(F.col("nmt_ready"), F.lit(False)), "not ready")
    )
    tex = kind == "tex"
    return requests.select("name", error.alias("error"), kind.alias("source_type"), F.when(tex, "ollama").otherwise(engine).alias("engine"), F.when(tex, "tex").otherwise(F.coalesce("layout", F.lit("fast"))).alias("layout"))


def validate_service_requests(requests: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``body_bytes, texts``: whether the model service takes the request."""
    chars = F.aggregate(F.transform("texts", lambda t: F.coalesce(F.char_length(t), F.lit(0))), F.lit(0), lambda a, x: a + x)
    ok = (F.col("body_bytes") <= settings.service_body_bytes) & F.size("texts").between(1, settings.service_texts) & ~F.exists("texts", lambda t: t.isNull()) & (chars <= settings.service_chars)
    return requests.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def catalog_options(options: DataFrame, installed: DataFrame) -> DataFrame:
    """Model options with whether they're installed; unknown (null) if no installed model is known."""
    names = installed.where("name is not null and name <> ''").select(F.col("name").alias("value")).distinct().withColumn("_there", F.lit(True))
    any_ = names.agg((F.count(F.lit(1)) > 0).alias("_any"))
    # one row, so it may be broadcast
    met = options.join(names, "value", "left").withColumn("_k", F.lit(1)).join(F.broadcast(any_.withColumn("_k", F.lit(1))), "_k")
    return met.select("engine", "value", "label", F.when(F.col("_any"), F.coalesce("_there", F.lit(False))).alias("installed"))




def model_options(spark) -> DataFrame:
    """The engines' models: ``engine, value, is_default``; a few rows."""
    return spark.createDataFrame([(e, m, i == 0) for e, models in MODELS.items() for i, m in enumerate(models)], "engine string, value string, is_default boolean")


def public_models(options: DataFrame, installed: DataFrame) -> DataFrame:
    """The catalogue as one row: ``installed`` (names in order) and ``catalog``, nested JSON of all engines with their models."""
    names = installed.agg(F.array_sort(F.collect_set("name")).alias("installed")).withColumn("_k", F.lit(1))
    each = catalog_options(options.withColumn("label", F.col("value")), installed).join(options.select("engine", "value", "is_default"), ["engine", "value"])
    models = each.groupBy("engine").agg(F.array_sort(F.collect_list(F.struct("value", "is_default", "installed"))).alias("models"))
    whole = models.agg(F.to_json(F.array_sort(F.collect_list(F.struct("engine", "models")))).alias("catalog")).withColumn("_k", F.lit(1))
    return names.join(F.broadcast(whole), "_k").drop("_k")  # one row each
