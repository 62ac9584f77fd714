"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives every document of it the same expected number of copies; the whole part is taken, the
rest is a probability. Fractional documents transfer mass at random, weighted by their sizes, until one side of a pair is integral, so the words
of the source stay what they were and each document's expected copies too. The largest document comes first, paired with the pool of all smaller ones, which
share one probability. Shards of a source are rounded independently and each leaves one residual at most; residuals are combined in
pairs in a tree of shards of shards until one is left, which is rounded at random by its probability.

Defined cases: a null text has size 0; documents of size 0 take the whole part of their copies; a text of any length is counted whole; a null source is a source of its own,
the last; a source is capped at twice its size; rows with the same id, source and text are one entry, whose copies are spread over them evenly; shards and random draws
depend on sources, ids, sizes and texts alone, so reruns agree, however the rows are laid out; an empty table gives an empty result; other columns are kept (``mixed``) or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, row_order

#: Weights of the sources in order, repeating; words to take in all; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
LEAF, FAN = 4096, 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, size)`` -> ``source, source_size, docs, target``.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. What lies above ``most`` times a source's size
    is shared again by weight: each round is one aggregate over the sources, until no more sources are capped.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    table, first = row_order(each, "sources", F.col("source").asc_nulls_last())
    spark = sizes.sparkSession
    start = spark.createDataFrame(sorted(first.items()), "_part long, first long")
    rank = (F.col("first") + F.col("_off")) % len(weights)
    weighed = table.join(F.broadcast(start), "_part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    weighed = materialize(weighed.select("source", "source_size", "docs", "weight", (F.col("source_size") * float(most)).alias("cap")), "weights")
    whole, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    want = share * (whole or 0)
    unit, capped = (want / weight if weight else 0.0), 0
    while True:
        above = F.col("weight") * unit > F.col("cap")
        n, held, rest = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped:
            break
        capped, unit = n, ((want - held) / rest if rest else float("inf"))
    target = F.least(F.col("cap"), F.col("weight") * F.lit(unit)) if unit != float("inf") else F.col("cap")
    return weighed.select("source", "source_size", "docs", target.alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after pairwise rounding in the given order (the largest first); one entry at most stays fractional. ``sum(size * p)`` doesn't change, nor does any entry's expectation.

    Entries that share their probability (as those of one source do) are rounded one by one against the pool of all that follow, which goes on sharing
    one probability: a large document is settled against many small ones, and what stays fractional is small. Others meet in pairs.
    """
    r = np.random.default_rng(seed)
    draw = r.random(2 * len(p)).tolist()
    w, out = size.astype(float).tolist(), p.tolist()
    open_ = [j for j in range(len(out)) if 0 < out[j] < 1]
    shared = Counter(out[j] for j in open_).most_common(1)[0][0] if open_ else None
    pool = [j for j in open_ if out[j] == shared]
    left = _against_pool(w, out, pool, shared, draw) if pool else -1
    i = -1
    for j in [j for j in open_ if j == left or p[j] != shared]:
        if i < 0:
            i = j
            continue
        out[i], out[j] = _pair(w[i], out[i], w[j], out[j], draw[len(p) + j])
        if not 0 < out[i] < 1:
            i = j if 0 < out[j] < 1 else -1
    return np.array(out, float)


def _pair(w: float, p: float, v: float, q: float, draw: float) -> tuple[float, float]:
    """Words move from one side (``w`` words at probability ``p``) to the other (``v``, ``q``) or back, until one is integral."""
    give, take = min(p * w, (1 - q) * v), min(q * v, (1 - p) * w)
    move = -give if draw * (give + take) < take else take
    return tuple(float(round(x)) if abs(x - round(x)) < 1e-9 else x for x in (p + move / w, q - move / v))


def _against_pool(w: list[float], out: list[float], pool: list[int], rate: float, draw: list[float]) -> int:
    """Rounds the entries of ``pool`` in order; returns the one that stays fractional, or -1."""
    rest = sum(w[j] for j in pool)
    for n, j in enumerate(pool):
        rest -= w[j]
        if n == len(pool) - 1:
            out[j] = rate
        else:
            out[j], rate = _pair(w[j], rate, rest, rate, draw[j])
        if 0 < out[j] < 1 or rate in (0.0, 1.0):  # the rest is integral, or there is none
            for k in pool[n + 1 :]:
                out[k] = rate
            return j if 0 < out[j] < 1 else -1
    return -1


_FIELDS = "row long, id long, source string, size long, key long, n long, whole long, p double, shard long"


def _round(table: pa.Table, last: bool) -> pa.Table:
    size, p = table["size"].to_numpy(), table["p"].to_numpy().copy()
    ids = table["id"].fill_null(2**63 - 1).to_numpy()
    order = np.lexsort((table["key"].to_numpy(), ids, -size))
    key = f"{table['source'][0].as_py()!r}/{table['shard'][0].as_py()}/{len(size)}/{size.sum()}"
    seed = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")
    p[order] = pivotal(size[order], p[order], seed)
    if last:  # one entry at most
        p = np.where((p > 0) & (p < 1), (np.random.default_rng(seed + 1).random() < p).astype(float), p)
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))


def _rounding(last: bool):
    return lambda table: _round(table, last)


def copies(docs: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``row, id, size, copies, source_size, target`` for every row of ``docs(row, id, source, size, key)``, which must be cheap to read several times.

    Rows with the same id, source, size and key are one entry with a number, which spreads its copies evenly over them.
    """
    slim = docs.select("row", F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"), "key")
    goals = materialize(targets(slim), "targets")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("?"))
    same = slim.groupBy("id", "source", "size", "key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    met = same.withColumn("k", named(F.col("source"))).join(goals.select(named(F.col("source")).alias("k"), "docs", "source_size", "target"), "k")
    want = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = met.withColumn("whole", F.floor(want)).withColumn("p", F.when(F.col("size") > 0, want - F.floor(want)).otherwise(0.0))
    shards = F.ceil(F.col("docs") / leaf)
    leaves = rated.withColumn("shard", F.pmod(F.xxhash64("id", "size", "key"), shards)).select("row", "id", "source", "size", "key", "n", "whole", "p", "shard")
    most = goals.agg(F.max(F.ceil(F.col("docs") / leaf))).first()[0] or 1
    level = materialize(leaves.groupBy("source", "shard").applyInArrow(_rounding(most <= 1), _FIELDS), "rounded")
    open_ = "p > 0 and p < 1"
    done = level.where(f"not ({open_})")
    while most > 1:
        most = -(-most // fan)
        up = level.where(open_).withColumn("shard", F.floor(F.col("shard") / fan))
        level = materialize(up.groupBy("source", "shard").applyInArrow(_rounding(most <= 1), _FIELDS), "residuals")
        done = done.unionByName(level.where(f"not ({open_})"))
    taken = done.select("row", "id", "source", "size", "key", "n", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    found = taken.where("n = 1").select("row", "id", "source", "size", "copies").unionByName(_spread(slim, taken.where("n > 1")))
    return found.withColumn("k", named(F.col("source"))).join(goals.select(named(F.col("source")).alias("k"), "source_size", "target"), "k").drop("k", "source")


def _spread(slim: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows behind entries of several rows. Rows are numbered within partitions of the table, and these by their counts, so that no entry meets in one task."""
    one = taken.select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("key").alias("_k"), F.col("row").alias("entry"), "n", "copies")
    same = F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("key") == F.col("_k"))
    rows = slim.join(one, same).select("row", "id", "source", "size", "entry", "n", "copies", F.shiftright("row", 33).alias("part"))
    parts = rows.groupBy("entry", "part").agg(F.count(F.lit(1)).alias("c"))
    before = parts.select("entry", "part", (F.sum("c").over(W.partitionBy("entry").orderBy("part")) - F.col("c")).alias("before"))
    number = F.row_number().over(W.partitionBy("entry", "part").orderBy("row")) - 1
    placed = rows.withColumn("number", number).join(before, ["entry", "part"])
    extra = (F.col("before") + F.col("number") < F.col("copies") % F.col("n")).cast("long")
    return placed.select("row", "id", "source", "size", (F.floor(F.col("copies") / F.col("n")) + extra).alias("copies"))


def sized(text: Column) -> Column:
    """Words of a text, as ``size``: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), sized(text), F.xxhash64(text.cast("string")).alias("key"), F.monotonically_increasing_id().alias("row")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted)."""
    found = copies(materialize(docs.select(*_slim(docs, id_col, text_col, source_col)), "mix"))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they are."""
    whole = materialize(docs.select(F.struct("*").alias("doc"), *_slim(docs, id_col, text_col, source_col)), "mix-whole")
    found = copies(whole).select("row", "copies").where("copies > 0")
    return whole.join(found, "row").select("doc", F.explode(F.expr("sequence(1L, copies)"))).select("doc.*")
