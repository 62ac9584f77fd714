import io
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from doclattice.config import batch_limits
from doclattice.functions.limits import job_memory_mb
from doclattice.operators import jobs as J
from doclattice.operators import translate as V
from doclattice.sources.archives import expand, safe_path, unpack
from doclattice.sources.testdata import job_events
from doclattice.streaming.jobs import job_states


def test_memory(spark):
    rows = spark.createDataFrame([("qwen2.5:3b", "ollama"), ("qwen3:30b", "ollama"), ("a", "nmt"), ("x", "ollama"), (None, "ollama")], "m string, e string")
    assert [r[0] // 1024 for r in rows.select(job_memory_mb(F.col("m"), F.col("e"))).collect()] == [8, 48, 6, 20, 20]


def test_admission(spark):
    rows = [(0, i, "submit") for i in range(8)] + [(0, 8, "finish"), (0, 9, "submit")]
    got = J.admitted(spark.createDataFrame(rows, "h int, i int, kind string"), ["i"], ["h"]).where("kind = 'submit'").orderBy("i")
    assert [r["accepted"] for r in got.collect()] == [True] * 6 + [False, False, True]


def test_head_blocks(spark):
    rows = [(0, 1, "queued", "ollama", "a:30b"), (0, 2, "queued", "ollama", "a:30b"), (0, 3, "queued", "ollama", "a:30b"), (0, 4, "queued", "ollama", "a:3b")]
    got = J.dispatch(spark.createDataFrame(rows, "h int, i int, status string, engine string, model string"), ["i"], ["h"], 102400).orderBy("i")
    assert [r["started"] for r in got.collect()] == [True, True, False, False]  # the small one waits behind the head


def test_percent(spark):
    assert spark.range(1).select(J.done_percent(F.lit(1), F.lit(3))).first()[0] == 36


def test_limits():
    assert batch_limits("llm", "fast") == (48, 14000)
    assert batch_limits("copy", "anything") == (16, 4800)


def test_ttl(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(1, "complete", now - timedelta(hours=2)), (2, "complete", now - timedelta(minutes=5)), (3, "running", None)]
    got = J.expire(spark.createDataFrame(rows, "job_id int, status string, completed_at timestamp"), F.lit(now))
    assert sorted(r["job_id"] for r in got.collect()) == [2, 3]


def test_resilient():
    def refuse(texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise V.TranslationError("no")
        return [texts[0].upper()]

    t = V.FunctionTranslator(refuse)
    assert V.resilient(["a", "bad", "c"], t) == [("A", "ok"), ("bad", "source"), ("C", "ok")]
    long = "\n\n".join(["good " * 150, "good " * 150])
    with_retry = V.FunctionTranslator(lambda ts: [x.upper() for x in ts] if all(len(x) < 1000 for x in ts) else (_ for _ in ()).throw(V.TranslationError("long")))
    assert V.resilient([long], with_retry)[0][1] == "pieces"
    with pytest.raises(V.TranslationError):
        V.resilient(["a", "b"], V.FunctionTranslator(refuse, engine="nmt"))
    with pytest.raises(ValueError):
        V.build_translator("other")


def test_regions_are_translated_once(spark):
    rows = [(1, p, r, "Same  text", True) for p in range(3) for r in range(2)] + [(1, 9, 9, "keep", False)]
    regions = spark.createDataFrame(rows, "doc_id long, page_no int, region_no int, text string, translatable boolean")
    got = V.translate_regions(regions, V.FunctionTranslator(lambda ts: [x.upper() for x in ts], "llm"), "quality").collect()
    assert {(r["translatable"], r["translated_text"]) for r in got} == {(True, "SAME  TEXT"), (False, "")}
    assert len(got) == 7
    paged = V.translate_regions(regions, V.FunctionTranslator(lambda ts: [x.upper() for x in ts], "llm"), "page")
    assert paged.count() == 7


def archive(kind):
    data = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("a/main.tex", "x")
            z.writestr("__MACOSX/a", "y")
    else:
        with tarfile.open(fileobj=data, mode="w:gz") as t:
            info = tarfile.TarInfo("main.tex")
            info.size = 1
            t.addfile(info, io.BytesIO(b"x"))
    return data.getvalue()


def test_archives(spark):
    assert unpack("p.zip", archive("zip")) == [("a/main.tex", b"x")]
    assert unpack("p.tar.gz", archive("tar")) == [("main.tex", b"x")]
    with pytest.raises(ValueError):
        unpack("p.zip", archive("zip"), most=0)
    for bad in ("../x", "/x", "a/../../x", "..\\x"):
        with pytest.raises(ValueError):
            safe_path(bad)
    rows = spark.createDataFrame([("p.zip", archive("zip")), ("q.zip", b"no zip")], "path string, content binary")
    got = {r["project"]: (r["path"], r["error"] is None) for r in expand(rows).collect()}
    assert got == {"p.zip": ("a/main.tex", True), "q.zip": (None, False)}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else time-outs are looked for without end
    events = job_events(spark, sf_dir).select("job_id", "seq", "state", "percent")
    for i in range(3):
        events.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = job_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["job_id"]: (r["status"], r["percent"]) for r in spark.sql("select job_id, max_by(struct(status, percent), last_seq) s from states group by 1").select("job_id", "s.*").collect()}
    want = {r["job_id"]: (r["status"], r["percent"]) for r in J.latest_state(job_events(spark, sf_dir)).collect()}
    assert got == want


def test_structured():
    """A region that fails as structured is tried plain; engines without free text fall back region by region."""

    class Picky(V.FunctionTranslator):
        def translate_batch_structured(self, texts):
            if "b" in texts:
                raise V.TranslationError("no structured reply")
            return [t.upper() for t in texts]

    assert V.structured_regions(["a", "b", "c"], Picky(lambda ts: ["plain " + t for t in ts])) == [("A", "ok"), ("plain b", "plain"), ("C", "ok")]

    def never(texts):
        raise V.TranslationError("down")

    assert V.structured_regions(["a", "b"], Picky(never, engine="nmt")) == [("a", "source"), ("b", "source")]
    assert V.structured_regions(["a"], V.FunctionTranslator(lambda ts: [""])) == [("a", "ok")]
    assert V.halving(["a", "b"], V.FunctionTranslator(never)) == [("a", "source"), ("b", "source")]
    assert V.halving(["a"], V.FunctionTranslator(lambda ts: 1 / 0)) == [("a", "source")]


def test_registry():
    assert V.build_translator(" Copy ").translate_batch([" a "]) == ["[Copy only]\na"]
    with pytest.raises(LookupError):
        V.build_translator("nmt")
    with pytest.raises(ValueError):
        V.build_translator("other")
    V.register_translator("nmt", lambda model: V.FunctionTranslator(lambda ts: [model] * len(ts), "nmt"))
    try:
        assert V.build_translator("NMT").translate_batch(["x"]) == ["nllb-200-distilled-600m"]
    finally:
        V._REGISTRY.pop("nmt")
