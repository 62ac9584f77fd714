import random

import pytest
from pyspark.sql import functions as F

from doclattice.operators import layout as L
from doclattice.operators.folds import greedy_batches
from doclattice.schemas import WORDS
from doclattice.sources.testdata import words


def page(spark, rows):
    return spark.createDataFrame([(1, 1, i, f"w{i}", *r, None, None) for i, r in enumerate(rows)], WORDS)


def test_anchor_not_lag(spark):
    got = L.assign_lines(page(spark, [(10.0 * i, 10.0 * i + 9, 2.0 * i) for i in range(4)])).orderBy("word_seq")
    assert [r["line_no"] for r in got.collect()] == [0, 0, 1, 1]


@pytest.mark.parametrize("x0, segments", [(110.0, 1), (110.5, 2)])
def test_gap(spark, x0, segments):
    got = L.words_to_lines(page(spark, [(50.0, 100.0, 5.0), (x0, 150.0, 5.0)]))
    assert got.count() == segments
    assert got.agg(F.max("bottom")).first()[0] == 5.0  # bottom defaults to top


@pytest.mark.parametrize("left, right, want", [(4, 2, True), (17, 3, False), (3, 9, False)])
def test_two_column(spark, left, right, want):
    rows = [(1, 1, float(i * 20), 10.0, 100.0) for i in range(left)] + [(1, 1, float(i * 20), 400.0, 500.0) for i in range(right)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, top double, x0 double, x1 double")
    assert L.two_column_pages(lines, 612.0).first()["two_column"] is want


@pytest.mark.parametrize("gap, shift, regions", [(4.8, 27.9, 1), (4.9, 0.0, 2), (-3.0, 0.0, 1), (1.0, 28.0, 2)])
def test_region_flow(spark, gap, shift, regions):
    rows = [(1, 1, 0, 0, 100.0, 110.0, 50.0, 200.0, "some words here"), (1, 1, 1, 0, 110.0 + gap, 130.0, 50.0 + shift, 200.0, "more words here")]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, seg_no int, top double, bottom double, x0 double, x1 double, text string")
    assert L.regions(L.group_regions(lines, 300.0), 300.0, 400.0).count() == regions


def test_partitioning_and_order_do_not_matter(spark, sf_dir):
    some = words(spark, sf_dir).where("doc_id < 6")
    one = sorted(map(str, L.layout_regions(some.coalesce(1), 612.0, 792.0).collect()))
    many = sorted(map(str, L.layout_regions(some.orderBy(F.rand(3)).repartition(7), 612.0, 792.0).collect()))
    assert one == many


def test_greedy_batches(spark):
    rows = [(1, i, n) for i, n in enumerate([4, 4, 4, 20, 1])]
    got = greedy_batches(spark.createDataFrame(rows, "k int, i int, n int"), ["k"], ["i"], "n", 2, 10).orderBy("i")
    assert [r["batch_id"] for r in got.collect()] == [0, 0, 1, 2, 3]


def test_greedy_batches_hold_limits(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(0, 12)) for k in range(5) for i in range(60)]
    got = greedy_batches(spark.createDataFrame(rows, "k int, i int, n int").repartition(3), ["k"], ["i"], "n", 5, 20)
    each = got.groupBy("k", "batch_id").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).collect()
    assert all(x["c"] <= 5 and (x["s"] <= 20 or x["c"] == 1) for x in each)
    assert got.count() == len(rows)


def test_images(spark):
    texts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "doc_id long, page_no int, source_text string")
    images = spark.createDataFrame([(1, 1, "p1"), (1, 4, "p4")], "doc_id long, page_no int, image_path string")
    got = {r["page_no"]: (r["source_text"], r["image_path"]) for r in L.page_image_pairs(texts, images).collect()}
    assert got == {1: ("a", "p1"), 2: ("b", "p4"), 3: ("c", "p4"), 4: ("", "p4")}


def test_empty_words(spark):
    assert L.layout_regions(page(spark, []), 612.0, 792.0).count() == 0
    assert L.page_text(page(spark, []), 612.0).count() == 0


def test_fit_text_reads_whole_lines(spark, tmp_path):
    """Lines that differ after 400 characters alone are fitted to different numbers of lines or sizes."""
    from doclattice.plans.layout import q_fit_text

    texts = [(1, "word " * 80), (2, "word " * 400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["size"], r["n_lines"]) for r in q_fit_text(spark, str(tmp_path)).collect()}
    assert got[1] != got[2]


def test_layout_query_equals_sql_on_kept_pages(spark, tmp_path):
    """A page that is hard to read: the query has its regions' own flags, as the SQL, and the operator keeps them all."""
    import duckdb
    from canon import canonical

    from doclattice.plans import catalog

    spark.createDataFrame([(2, "word " + "enê è ç " * 60)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()["layout_regions"](spark, str(tmp_path)).toPandas()
    assert canonical(got) == canonical(c.execute(catalog.oracle_sql()["layout_regions"]).df())
    assert got["translatable"].any()
    assert not L.layout_regions(words(spark, str(tmp_path)), 612.0, 792.0).toPandas()["translatable"].any()
