import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, found[-1], sf_dir).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_stages(spark, steps):
    docs, good, lines, single, mix, packed = steps
    for kept in (good, lines, single, mix):
        assert kept.columns == docs.columns
    assert good.count() < docs.count() and good.exceptAll(docs).count() == 0
    assert lines.count() == good.count() and lines.where("n_chars <> char_length(text)").count() == 0
    assert 0 < single.count() <= lines.count() and single.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mix.select("doc_id").distinct().join(single, "doc_id", "left_anti").count() == 0
    assert packed.count() == mix.count()


def test_clean_documents_stay(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean, junk = labels.where("quality = 1"), labels.where("quality = 0")
    assert steps[1].join(clean, "doc_id", "left_semi").count() >= 0.97 * steps[0].join(clean, "doc_id", "left_semi").count()
    assert steps[1].join(junk, "doc_id", "left_semi").count() <= 0.2 * steps[0].join(junk, "doc_id", "left_semi").count()


def test_run_equals_stages(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[-1].count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_odd(spark, sf_dir, odd, none, name, stage):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns named as the operators name theirs."""
    for docs in (odd, none):
        got = stage(spark, docs, sf_dir)
        rows = got.count()
        assert rows <= 2 * docs.count() and (rows > 0) == (docs is odd)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
