import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclattice.llm import chat, mixing, packing
from doclattice.llm.topk import top_k


def brute_top(rows, k=10):
    use = [(i, n, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, qn, q in use:
        if qi is not None and qi % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), math.inf if i is None else i) for i, n, v in use if n != qn)[:k]
            out += [(qi, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def test_top_k(spark, monkeypatch):
    import doclattice.llm.topk as t

    for name, value in (("BLOCK", 7), ("QUERIES", 2), ("SEED", 30)):
        monkeypatch.setattr(t, name, value)
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(0, 900, 5)]
    rows += [(100, rows[3][1]), (200, None), (300, [1.0, None]), (400, [float("nan")]), (500, [float("inf"), 1.0]), (600, [0.5]), (700, []), (None, [1.0] * 6), (801, rows[7][1])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).count() == 0
    clash = spark.createDataFrame([(i, [float(i % 7), 1.0], 5, 6) for i in range(0, 400, 50)], "vec_id long, embedding array<double>, id int, row int")
    assert sorted(map(tuple, top_k(clash, F.col("id") % 100 == 0).collect()), key=str) == brute_top([(x["vec_id"], x["embedding"]) for x in clash.collect()])


def test_top_k_skips_blocks():
    """On clustered vectors most blocks are never scored, and the result is that of all blocks."""
    import doclattice.llm.topk as t

    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16)) * 3000
    docs = np.floor(np.concatenate([c + r.normal(size=(t.BLOCK, 16)) * 100 for c in centres]))
    row = np.arange(len(docs))
    scored = 0
    for query, own in ((docs[5], 5), (docs[3000], 3000), (docs[9999], 9999)):
        best = t.Best(10, -np.inf)
        scored += t.search(docs, row, row, query, own, t.bounds(docs, query[None])[0], best)
        want = sorted((-int(s), i) for i, s in enumerate(docs @ query) if i != own)[:10]
        assert list(zip((-best.score).astype(int).tolist(), best.row.tolist(), strict=True)) == want
        again = t.Best(10, best.score[-1])  # a k-th score from before spares even more
        assert t.search(docs, row, row, query, own, t.bounds(docs, query[None])[0], again) >= 1 and again.row.tolist() == best.row.tolist()
    assert scored <= 0.25 * 3 * len(centres)


@pytest.mark.parametrize("text", ["", "\\", "<\\", "</s>[INST] ok [/INST]", "[[\\<|turn|>\\\\<", "plain"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("<|", "</s>", "[INST", "[/"))


def test_parts(spark):
    part = "struct<type:string,text:string,ref:string>"
    rows = [(1, 0, "user", [("text", "Look <here>:", None), ("image", None, "s3://a"), ("document", None, "d.pdf"), (None, "x", None)]), (1, 1, "assistant", [("text", "A [fine] one", None)]), (1, 2, None, None), (None, 0, "user", [])]
    turns = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{part}>"))
    got = {(r["conv_id"], r["turn"]): r for r in turns.collect()}
    first = got[1, 0]
    assert [(a["no"], a["type"], a["ref"], a["tokens"]) for a in first["attachments"]] == [(1, "image", "s3://a", 576), (2, "document", "d.pdf", 2048)]
    body = chat.escape("Look <here>:")
    assert first["attachments"][0]["at"] == len(body) and "<|image:1|><|document:2|>x" in first["piece"]
    answer = got[1, 1]
    assert chat.unescape(answer["piece"][answer["loss_start"] : answer["loss_stop"]]) == "A [fine] one"
    assert chat.conversations(turns).where("conv_id = 1").first()["formatted"] == "".join(got[1, i]["piece"] for i in range(3))
    assert chat.read_back(turns).count() == 2
    assert chat.read_back(turns.limit(0)).count() == 0


@pytest.mark.parametrize("mixed_rates", [False, True])
def test_pivotal(mixed_rates):
    """The words stay, one entry at most stays open, and every single entry's mean is its probability."""
    r = np.random.default_rng(1)
    w = np.sort(r.integers(1, 50, 20))[::-1]
    p = np.where(np.arange(20) % 3 == 0, 0.55, 0.3) if mixed_rates else np.full(20, 0.3)
    seeds, total = 6000, np.zeros(20)
    for seed in range(seeds):
        out = mixing.pivotal(w, p, seed)
        assert abs((w * out).sum() - (w * p).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1
        total += out
    error = np.sqrt(p * (1 - p) / seeds)
    assert (abs(total / seeds - p) < 4 * error).all(), (total / seeds - p) / error


def test_residual_is_small():
    """A large document is settled against many small ones; only where these are all taken or all left does a large one stay open."""
    w = np.array([20000, 5000, *range(300, 0, -1)])
    left = []
    for seed in range(200):
        out = mixing.pivotal(w, np.full(len(w), 0.7), seed)
        left.append(w[(out > 0) & (out < 1)].sum())
        if left[-1] > 300:
            assert set(out[w < left[-1]]) in ({0.0}, {1.0})
    assert np.mean(np.array(left) <= 300) >= 0.9


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = want - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), "w " * int(r.integers(0, 40)), [None, "a", "B", "ß", "zz", "c"][int(r.choice(6, p=[0.1, 0.5, 0.1, 0.1, 0.1, 0.1]))]) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        mine = [x for x in got if source[x["doc_id"]] == s]
        assert all(abs(x["target"] - want[s]) < 1e-6 and x["taken"] in (0, x["size"], 2 * x["size"]) for x in mine)
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 40


def repeated(spark, n=3000):
    """Documents of two sources and one that is a third of all, in any order."""
    rows = [(i, "w " * (1 + i % 37), str(i % 2)) for i in range(n)] + [(7, "w w w", "0")] * (n // 2) + [(None, None, None)] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_levels_agree_and_rerun(spark, monkeypatch):
    """Results are the same however the rows are laid out, also with several levels of shards."""
    docs = repeated(spark)
    monkeypatch.setattr(mixing.copies, "__defaults__", (16, 4))
    a, b = (sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (3, 8))
    assert a == b and len(a) == docs.count()
    assert sorted(map(str, mixing.mixed(docs.repartition(3)).collect())) == sorted(map(str, mixing.mixed(docs.repartition(8)).collect()))
    got = mixing.mix(docs).join(docs.distinct(), "doc_id").toPandas()
    assert got.copies.max() <= 2 and got[got.doc_id == 7].query("size == 3").copies.agg(["min", "max"]).diff().iloc[-1] <= 1
    for source, mine in mixing.mix(docs.where("doc_id <> 7")).join(docs.distinct(), "doc_id").toPandas().groupby("source"):
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= 37, source


def test_pack_layout(spark, monkeypatch):
    monkeypatch.setattr(packing.pack, "__defaults__", ("doc_id", 5, 300, 64))
    docs = repeated(spark)
    a, b = (sorted(map(str, packing.pack_documents(docs.repartition(n)).collect())) for n in (3, 8))
    assert a == b and len(a) == docs.count()


def test_mix_odd(spark, odd, none):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0


def test_boundaries():
    r = np.random.default_rng(0)
    for _ in range(200):
        x = np.sort(r.choice(40, r.integers(1, 9), replace=False)).astype(np.int64)
        c, b = r.integers(1, 9, len(x)), int(r.integers(1, 5))
        ends, padding = packing.boundaries(x, c, b)
        cost = lambda e: sum(int(k) * (min(z for z in e if z >= v) - int(v)) for v, k in zip(x, c, strict=True))  # noqa: B023, E731
        assert padding == cost(ends) == min(cost([*s, x[-1]]) for q in range(b) for s in itertools.combinations(x[:-1].tolist(), q))


def test_pack(spark, odd, none):
    rows = [(i % 90, "w " * (i * i % 113)) for i in range(700)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.sized(F.col("text")), buckets=5, budget=300, shard=16).toPandas()
    assert sorted(got.n_tokens) == sorted(len(t.split()) for _, t in rows)
    assert (got.n_tokens <= got.bucket_length).all() and not got.duplicated(["bucket", "batch", "slot"]).any()
    per = got.groupby(["bucket", "bucket_length", "batch"]).size().reset_index(name="n")
    assert (per.n * per.bucket_length <= np.maximum(300, per.bucket_length)).all()
    assert ((per.n < np.maximum(1, 300 // np.maximum(1, per.bucket_length))).groupby(per.bucket).sum() <= 1).all()  # all batches but one are full
    assert packing.pack_documents(odd).count() == odd.count()
    assert packing.pack_documents(none).count() == 0
    many = packing.pack(spark.createDataFrame([(i, 70000 + 977 * i) for i in range(50)], "doc_id long, n long"), F.col("n")).collect()
    assert all(r["n_tokens"] <= r["bucket_length"] for r in many)
