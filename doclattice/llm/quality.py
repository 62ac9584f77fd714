"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by one filter width less one, so every window of the whole text is
seen once. Learned filters run over each chunk, the largest response of each filter goes through a small
hidden layer, and the mean over all chunks gives one probability. A filter over byte embeddings is a sum
of table look-ups, one table of 256 rows for each place in the filter.

Defined cases: a null or empty text is one chunk of padding and gets a score like any other; a text of any length is read whole,
a few hundred chunks at a time; labels that are null don't count, of several labels for one id the smallest does; repeated rows each
get their score; without labels of both kinds every score is the share of label 1 (1 if there is no label at all); an empty table gives
an empty result; other columns are kept, whatever their names, but one named like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, WIDTH, EMBED, FILTERS, HIDDEN = 128, 6, 8, 24, 16
#: Bound of the training sample: labelled documents, whose whole texts are learned from.
SAMPLE_DOCS = 2400
STEPS, DOCS_A_STEP, RATE = 300, 32, 0.01
CUT = 0.3


def chunk_starts(size: int) -> np.ndarray:
    return np.arange(0, max(size - WIDTH + 1, 1), CHUNK - WIDTH + 1)


def _cut(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks of bytes from ``at``, zero beyond ``end``."""
    place = at[:, None] + np.arange(CHUNK)
    inside = place < end[:, None]
    return np.where(inside, data[np.where(inside, place, 0)] if len(data) else 0, 0).astype(np.uint8)


class Network:
    """Parameters by name; ``tables`` are the filters folded with the embeddings, for scoring."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.tables = [np.ascontiguousarray((weights["embed"] @ weights["filter"][j]).astype(np.float32)) for j in range(WIDTH)]

    @staticmethod
    def fresh(seed: int = 7) -> dict[str, np.ndarray]:
        r = np.random.default_rng(seed)
        return {
            "embed": r.normal(0, 0.5, (256, EMBED)), "filter": r.normal(0, 0.4, (WIDTH, EMBED, FILTERS)), "fb": np.zeros(FILTERS),
            "v": r.normal(0, 0.3, (FILTERS, HIDDEN)), "vb": np.zeros(HIDDEN), "o": r.normal(0, 0.3, HIDDEN), "ob": np.zeros(1),
        }

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all filters at all places of chunks ``x``."""
        n = CHUNK - WIDTH + 1
        z = self.tables[0][x[:, :n]]
        for j in range(1, WIDTH):
            z += self.tables[j][x[:, j : j + n]]
        return z

    def hidden(self, x: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pool(x).max(axis=1) + self.w["fb"], 0)
        return np.maximum(top @ self.w["v"] + self.w["vb"], 0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """One probability for each text of an Arrow binary array."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        sizes = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        counts = np.maximum(-(-(sizes - WIDTH + 1) // (CHUNK - WIDTH + 1)), 1)
        last = np.cumsum(counts)
        total = np.zeros((len(texts), HIDDEN))
        for a in range(0, int(last[-1]) if len(last) else 0, 256):
            no = np.arange(a, min(a + 256, int(last[-1])))
            doc = np.searchsorted(last, no, side="right")
            at = offsets[doc] + (no - (last[doc] - counts[doc])) * (CHUNK - WIDTH + 1)
            np.add.at(total, doc, self.hidden(_cut(data, at, offsets[doc] + sizes[doc])))
        logit = (total / counts[:, None]) @ self.w["o"] + self.w["ob"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradients(w: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over documents with labels ``y``, and its gradients. ``x`` has the chunks of all documents, ``of`` the document of each. The pooled maximum passes its gradient to one place."""
    net, n = Network(w), np.bincount(of, minlength=len(y))
    z = net.pool(x)
    place = z.argmax(axis=1)
    top = np.take_along_axis(z, place[:, None], axis=1)[:, 0] + w["fb"]
    a = np.maximum(top, 0)
    h = np.maximum(a @ w["v"] + w["vb"], 0)
    doc = np.zeros((len(y), HIDDEN))
    np.add.at(doc, of, h / n[of, None])
    p = 1 / (1 + np.exp(-np.clip(doc @ w["o"] + w["ob"][0], -30, 30)))
    loss = -np.mean(np.log(np.where(y, p, 1 - p)))
    d = (p - y) / len(y)
    g = {"ob": np.array([d.sum()]), "o": doc.T @ d}
    dh = (d[:, None] * w["o"])[of] / n[of, None] * (h > 0)
    g |= {"vb": dh.sum(axis=0), "v": a.T @ dh}
    da = (dh @ w["v"].T) * (top > 0)
    g |= {"fb": da.sum(axis=0), "filter": np.zeros_like(w["filter"]), "embed": np.zeros_like(w["embed"])}
    column = np.arange(FILTERS)
    for j in range(WIDTH):
        byte = np.take_along_axis(x, place + j, axis=1).astype(np.int64)
        table = np.bincount((byte * FILTERS + column).ravel(), da.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        g["filter"][j] = w["embed"].T @ table
        g["embed"] += table @ w["filter"][j].T
    return float(loss), g


def train(docs: list[tuple[int, np.ndarray]], seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights from (label, all chunks of one document), by Adam on the log loss; a step takes whole documents."""
    r, w = np.random.default_rng(seed), Network.fresh(seed)
    share = np.mean([d[0] for d in docs]) if docs else 1.0
    if share in (0.0, 1.0):
        w["o"][:], w["ob"][0] = 0, 30 if share else -30
        return w
    by = [[c for label, c in docs if label == k] for k in (0, 1)]
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        y = np.arange(DOCS_A_STEP) % 3 > 0  # a third from label 0
        picked = [by[int(k)][r.integers(len(by[int(k)]))] for k in y]
        of = np.repeat(np.arange(len(picked)), [len(c) for c in picked])
        _, g = gradients(w, np.concatenate(picked), of, y)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in w:
            g[k] = g[k] + 1e-5 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_DOCS) -> Network:
    """Trains on at most ``most`` labelled documents, chosen by a hash of the id among those where ``may_learn`` (over the id) holds; at most half of one label where the other has enough."""
    known = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(may_learn)
    known = known.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("y").alias("y"))
    ids = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most // 2)
        ids = some if ids is None else ids.union(some)
    share = known.agg(F.avg("y")).first()[0]
    # ``ids`` holds ``most`` rows at most, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t")).join(F.broadcast(ids), id_col)
    texts = texts.groupBy(id_col).agg(F.min("y").alias("y"), F.min(F.coalesce("t", F.lit(""))).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["t"].cast(pa.binary()).to_pylist():
                data, at = np.frombuffer(text, np.uint8), chunk_starts(len(text))
                out.append(_cut(data, at, np.full(len(at), len(data))).tobytes())
            yield pa.RecordBatch.from_arrays([batch[id_col], batch["y"], pa.array(out, pa.binary())], [id_col, "y", "c"])

    rows = sorted(texts.mapInArrow(cut, f"{id_col} long, y int, c binary").collect(), key=lambda x: x[0])
    net = Network(train([(x[1], np.frombuffer(x[2], np.uint8).reshape(-1, CHUNK)) for x in rows]))
    if share not in (None, 0.0, 1.0):  # the steps see a third of label 0
        net.w["ob"] = net.w["ob"] + np.log(share / (1 - share)) - np.log(2)
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the probability of label 1. The Arrow function sees the text alone."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        parts = [net.scores(texts.slice(a, 256).cast(pa.binary())) for a in range(0, len(texts), 256)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(out, of(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``; columns as they are."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score(packed, net).where(F.col("score") >= cut).select("row.*")
