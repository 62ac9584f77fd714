import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclattice.llm import language as L
from doclattice.llm import quality as Q
from doclattice.llm.queries import op2, op4


def test_forward_backward():
    r = np.random.default_rng(0)
    emit, chain, trans, start = r.normal(size=(7, 3)), np.array([0, 0, 0, 0, 1, 2, 2]), r.normal(size=(3, 3)), r.normal(size=3)
    gamma, pairs, begins = L.forward_backward(emit, chain, trans, start)
    want_g, want_p, want_b = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3)
    for c in range(3):
        at = np.flatnonzero(chain == c)
        paths = list(itertools.product(range(3), repeat=len(at)))
        w = np.array([np.exp(start[y[0]] + emit[at, y].sum() + sum(trans[a, b] for a, b in itertools.pairwise(y))) for y in paths])
        for y, p in zip(paths, w / w.sum(), strict=True):
            want_g[at, y] += p
            want_b[y[0]] += p
            for a, b in itertools.pairwise(y):
                want_p[a, b] += p
    assert np.allclose(gamma, want_g) and np.allclose(pairs, want_p) and np.allclose(begins, want_b)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in op4.query(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.98


SWITCHED = [(0, d, ["the", "thing", "and", "that"]) for d in range(3)] * 14 + [(1, d, ["der", "einheit", "und", "nicht"]) for d in range(3, 6)] * 14


def test_code_switched_words():
    field = L.train(SWITCHED, ["en", "de"])
    coded, line, _ = L.split_words(pa.array(["the thing and der einheit und nicht"]))
    emit = field.emissions(coded.dictionary)[coded.indices.to_numpy()]
    gamma = L.forward_backward(emit, line, field.trans, field.start, False)[0]
    assert gamma.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1]


def test_lexicon():
    """Entries are the languages in which two documents or more hold the word."""
    lexicon = L.Lexicon([(0, 0, ["a", "b", "b"]), (0, 1, ["b", "c"]), (1, 2, ["b", "c"]), (1, 3, ["b", "c"]), (2, 4, ["c"])])
    at, labels = lexicon.entries(pa.array(["x", "b", "c", "a", "b"]))
    assert list(zip(at.tolist(), labels.tolist(), strict=True)) == [(1, 0), (1, 1), (2, 1), (4, 0), (4, 1)]
    assert [len(x) for x in L.Lexicon([]).entries(pa.array(["a"]))] == [0, 0]


def test_emissions_brute_force():
    """A word's emission is the sum of the weights of its affixes, n-grams and lexicon entries, each hashed byte by byte."""
    field = L.train(SWITCHED, ["en", "de"])
    field.weights = np.random.default_rng(4).normal(size=field.weights.shape).astype(np.float32)
    words = ["thing", "der", "x", "\u00e9t\u00e9", "unseen", "that"]

    def slot(kind, part):
        h = kind * 0x1000193 + len(part)
        for b in part:
            h = (h ^ b) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        return h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - L.BITS

    for word, got in zip(words, field.emissions(pa.array(words)), strict=True):
        data = word.encode()
        ids = [slot(1, data[i : i + n]) for n in (2, 3) for i in range(len(data) - n + 1)]
        ids += [slot(kind, part) for n in (1, 2, 3) if len(data) >= n for kind, part in ((2, data[:n]), (3, data[-n:]))]
        ids += [(1 << L.BITS) + y for y, known in ((0, ("the", "thing", "and", "that")), (1, ("der", "einheit", "und", "nicht"))) if word in known]
        assert np.allclose(got, field.weights[ids].astype(float).sum(axis=0), atol=1e-4)


def test_many_languages():
    """No language is left out: with more of them the table of hashed features has fewer rows."""
    words = [["".join(chr(97 + b % 26) for b in hashlib.sha256(f"{y}{s}".encode()).digest()[:8]) for s in "ab"] for y in range(300)]
    field = L.train([(y, 2 * y + d, words[y]) for y in range(300) for d in range(2)], [f"l{y:03d}" for y in range(300)])
    assert field.weights.size <= L.WEIGHTS + 300 * 300
    assert field.predict(pa.array([" ".join(w) for w in words]))[0] == field.labels


def test_language_odd(spark, odd, none):
    field = L.fit(odd, F.lit(True))
    got = L.predict(odd, field).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["text"] is None or r["doc_id"] in (1, 2, 9)} == {"und"}
    assert {r["lang_pred"] for r in L.predict(odd, L.fit(none, F.lit(True))).collect()} == {"und"}
    assert L.predict(none, field).count() == 0


def chunks_of(text):
    at = Q.chunk_starts(len(text))
    return Q._cut(np.frombuffer(text, np.uint8), at, np.full(len(at), len(text)))


def test_gradients_by_differences():
    r, w = np.random.default_rng(2), Q.Network.fresh(3)
    docs = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (5, 300, 700)]
    parts = [chunks_of(t) for t in docs]
    x, of, y = np.concatenate(parts), np.repeat(np.arange(3), [len(p) for p in parts]), np.array([True, False, True])
    w["embed"] = w["embed"].astype(np.float32).astype(float)
    _, g = Q.gradients(w, x, of, y)
    for name, step in (("o", 1e-4), ("v", 1e-4), ("vb", 1e-4), ("fb", 1e-3), ("filter", 1e-3), ("embed", 1e-3)):
        for place in np.argsort(-np.abs(g[name]).ravel())[:4]:
            sides = []
            for sign in (1, -1):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name].ravel()[place] += sign * step
                sides.append(Q.gradients(moved, x, of, y)[0])
            assert abs((sides[0] - sides[1]) / (2 * step) - g[name].ravel()[place]) < 0.05 * abs(g[name]).max() + 1e-5, name


def test_training_separates():
    docs = [(k, chunks_of(t * 20)) for k, t in ((1, b"Some words of plain text. "), (0, b"### $$$ %%% &&& *** ")) for _ in range(4)]
    net = Q.Network(Q.train(docs, steps=60))
    a, b = net.scores(pa.array([b"Some words of plain text. " * 5, b"### $$$ %%% &&& *** " * 5], pa.binary()))
    assert a > 0.9 and b < 0.2


def test_scores_brute_force():
    """Scores are those of a plain convolution: every filter at every place of every chunk, one product at a time."""
    net, r = Q.Network(Q.Network.fresh(5)), np.random.default_rng(6)
    texts = [b"", b"abc", bytes(r.integers(0, 256, 128).astype(np.uint8)), bytes(r.integers(0, 256, 500).astype(np.uint8))]
    for text, got in zip(texts, net.scores(pa.array(texts, pa.binary())), strict=True):
        total, starts = np.zeros(Q.HIDDEN), range(0, max(len(text) - Q.WIDTH + 1, 1), Q.CHUNK - Q.WIDTH + 1)
        for at in starts:
            chunk = text[at : at + Q.CHUNK].ljust(Q.CHUNK, b"\0")
            top = [max(sum(net.w["embed"][chunk[i + j]] @ net.w["filter"][j, :, f] for j in range(Q.WIDTH)) for i in range(Q.CHUNK - Q.WIDTH + 1)) for f in range(Q.FILTERS)]
            total += np.maximum(np.maximum(np.array(top) + net.w["fb"], 0) @ net.w["v"] + net.w["vb"], 0)
        assert abs(got - 1 / (1 + np.exp(-(total / len(starts) @ net.w["o"] + net.w["ob"][0])))) < 1e-4


def test_scores_see_every_byte():
    net = Q.Network(Q.Network.fresh())
    text = b"abcdefgh " * 4000
    changed = [text[:i] + b"\x01\x02\x03" + text[i + 3 :] for i in (0, 777, 20000, len(text) - 3)]
    scores = net.scores(pa.array([text, *changed], pa.binary()))
    alone = [net.scores(pa.array([t], pa.binary()))[0] for t in [text, *changed]]
    assert np.allclose(scores, alone)
    assert all(s != scores[0] for s in scores[1:])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in op2.query(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for p, y in got if y == 1]) > 0.97
    assert np.mean([p for p, y in got if y == 0]) < 0.15


@pytest.mark.parametrize("kinds", [[], [1], [0], [0, 1]])
def test_quality_odd(spark, odd, none, kinds):
    labels = spark.createDataFrame([(4, k) for k in kinds[:1]] + [(9, k) for k in kinds[1:]] + [(3, None), (None, 1)], "doc_id long, quality int")
    net = Q.fit(odd, labels, F.lit(True))
    got = Q.score(odd, net, out="p").collect()
    assert len(got) == odd.count() and all(0 <= r["p"] <= 1 for r in got)
    assert Q.keep_good(odd, net).columns == odd.columns
    assert Q.score(none, net).count() == 0
