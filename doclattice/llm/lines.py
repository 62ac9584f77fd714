"""Line dedup by MinHash over character shingles.

Lines are told apart exactly first; the rest is about different lines. A line's signature is the bottom-k form of MinHash: the ``SKETCH`` smallest
hashes of all its shingles. Each run of ``RUN`` neighbours in the sorted signature is a band; lines that share a band are candidates. For lines
with at most ``SKETCH`` shingles the signature is the whole set, and any two that are 0.8 alike share a band: d shingles that only one of them has cut the
4 * d or more that both have into d + 1 runs at most, one of which is long enough (sets of 4 and 5 also have bands of two). For longer lines that are
just 0.8 alike, 99.5 % share one.

Bands connect lines to families. In each family all lines meet, in blocks of bounded size, by the exact Jaccard similarity of the sets of all shingles; an
index of rare shingles spares pairs that can't be similar, and pairs that are connected already need no look. A family of more than ``FEW`` blocks (lines may hang together by common
passages) is gone through band by band, so that only lines which share a band meet. Either way every pair that shares a band is looked at, whatever the size of a band or family. Blocks return the links that
connect lines, not all links. Components of links keep one line: the first by (document id, place).

Signing and verifying run in numpy over Arrow batches (``shingles``): SQL functions take about a microsecond for each shingle, which alone is more than the time that the
operator may take. Lines, bands, heads, blocks and components are DataFrame operations.

Defined cases: a null text counts as empty and stays null; blank lines are no lines of this kind and stay; a line shorter than a
shingle is one shingle; a line of any length is read whole; repeated rows (same id and text) keep their lines once, in one
of the rows; a null id comes after all others; an empty table gives an empty result; other columns stay as they are, whatever their names, but those named like the two counts are
replaced by them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import connected_components, materialize
from .shingles import arrow_lists, char_sets, char_sketches, mix, similar

SHINGLE, SKETCH, RUN, SIMILARITY = 10, 14, 3, 0.8
#: Characters of a block, about; blocks of a family that is compared as a whole; bits of the bitmaps that spare rows a shuffle (8 MB, whatever the data).
BLOCK, FEW, BITS = 1 << 19, 8, 26


def bands_of(flat: np.ndarray, sizes: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of sketches, which lie one after the other: one for each run; a shorter sketch is one band. Sketches of four and five also have bands of two. Also their numbers."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # members from each on
    found, texts = [], []

    def add(size: int, start: np.ndarray) -> None:
        h = np.full(len(start), size << 52, np.uint64)
        for j in range(size):
            h = mix(h + flat[start + j])
        found.append(h)
        texts.append(of[start])

    add(run, np.flatnonzero(left >= run))
    add(run - 1, np.flatnonzero((left >= run - 1) & np.isin(sizes, (4, 5))[of]))
    for size in range(1, run):
        add(size, np.flatnonzero((left == size) & (sizes == size)[of]))
    texts = np.concatenate(texts)
    return np.concatenate(found)[np.argsort(texts, kind="stable")], np.bincount(texts, minlength=len(sizes))


def signed(line_col: str, shingle: int = SHINGLE, sketch: int = SKETCH) -> Column:
    """The bands of each line, as longs."""

    @F.arrow_udf("array<bigint>")
    def of(lines: pa.Array) -> pa.Array:
        found = [bands_of(flat, n) for flat, n, _ in char_sketches(lines, shingle, sketch)]
        return arrow_lists(np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)]), np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)]))

    return of(F.col(line_col))


def _bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """Bits of the hashes in ``col``: what isn't among them has one by chance only. The driver gets ``2 ** (BITS - 3)`` bytes at most."""
    at = F.col(col).bitwiseAND((1 << BITS) - 1)
    rows = keys.select(F.shiftright(at, 15).alias("k"), at.bitwiseAND(32767).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((1 << BITS - 15, 4096), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & ((1 << BITS) - 1)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _key(id_col: str) -> Column:
    """The id with nulls last, as the largest long."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(_key(id_col).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(text, F.lit("")).alias("t"))


def first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id, th, keep``: per (id, hash of text) the places, from 0, of the lines that stay; texts that keep none don't appear."""
    own = _identified(docs, id_col, text_col)
    lines = own.select("id", "th", F.posexplode(F.split("t", "\n")).alias("no", "line")).where(r"line rlike '\\S'")
    place = F.struct(F.col("id").alias("id"), F.col("no").alias("no"), F.col("th").alias("th"))
    hashed = lines.select(place.alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")
    ready = hashed.select("place", "h1", "h2", signed("line").alias("bands"))
    distinct = ready.groupBy("h1", "h2").agg(F.min(F.struct("place", "bands")).alias("f")).select("h1", "h2", "f.place", "f.bands")
    known = materialize(distinct.withColumn("uid", F.monotonically_increasing_id()), "lines")
    roots = line_groups(known.select("uid", "bands"), lambda wanted: _line_texts(known.join(wanted, "uid").select("uid", "h1", "h2"), hashed), similarity)
    grouped = known.join(roots, F.col("uid") == F.col("node"), "left").select("place", F.coalesce("root", "uid").alias("root"))
    grouped = grouped.groupBy("root").agg(F.min("place").alias("place"))
    return grouped.select("place.id", "place.th", "place.no").groupBy("id", "th").agg(F.sort_array(F.collect_list("no")).alias("keep"))


def line_groups(known: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of all linked lines. ``known`` has ``uid, bands`` of different lines; ``texts_of`` gives ``uid, line`` for a frame of ``uid``."""
    # counted by partial aggregates, so a band that a third of all lines share is no task's burden
    counted = known.select("uid", F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("head"), F.max("uid").alias("last")).where("c > 1")
    shared = materialize(counted, "line-bands")
    big = shared.where("c > 2").select("band", "head", "c")
    bitmap = _bitmap(big, "band")

    @F.arrow_udf("array<bigint>")
    def maybe(bands: pa.Array) -> pa.Array:
        of = np.repeat(np.arange(len(bands)), pc.list_value_length(bands).to_numpy(zero_copy_only=False))
        flat = bands.flatten().to_numpy()
        kept = _set(bitmap, flat)
        return arrow_lists(flat[kept], np.bincount(of[kept], minlength=len(bands)))

    some = known.select("uid", F.explode(maybe("bands")).alias("band")).join(big, "band")
    # bands with the same members are one
    print_ = some.groupBy("band").agg(F.expr("bit_xor(xxhash64(uid))").alias("print"), F.first("c").alias("c"), F.first("head").alias("head"))
    one = materialize(print_.groupBy("c", "head", "print").agg(F.min("band").alias("band")).select("band", "c", "head"), "line-big")
    held = materialize(some.select("band", "uid").join(one, "band"), "line-members")
    pairs = shared.where("c = 2").select("band", "head", "last")
    first = pairs.select(F.col("last").alias("uid"), "head").unionByName(held.where("uid <> head").select("uid", "head")).distinct()
    families = connected_components(first.select(F.col("uid").alias("a"), F.col("head").alias("b")), "line-families")
    texts = materialize(texts_of(families.select(F.col("node").alias("uid"))).withColumn("n", F.char_length("line") + 1), "line-texts")
    sizes = families.join(texts.select(F.col("uid").alias("node"), "n"), "node").groupBy("root").agg(F.sum("n").alias("n"))
    wide = sizes.where(F.col("n") > FEW * BLOCK).select("root")
    links = compared(families.join(wide, "root", "left_anti").select(F.col("root").alias("key"), F.col("node").alias("uid")), texts, similarity)
    if wide.take(1):
        of = families.join(wide, "root", "left_semi").select(F.col("node").alias("uid"))
        by_band = held.select("band", "uid").unionByName(pairs.select("band", F.explode(F.array("head", "last")).alias("uid")))
        # an inner join, as uids are unique in ``of``: a semi-join is pushed below the union, which then counts as dealt by uid in half the partitions that it has, and the next join fails
        links = links.unionByName(compared(by_band.join(of, "uid").select(F.col("band").alias("key"), "uid"), texts, similarity))
    return connected_components(links, "lines-cc")


def compared(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links enough to connect all members (key, uid) of a key that are as similar as asked; ``texts`` has ``uid, line, n`` (characters).

    Keys of one block are compared many at a time; others block by block.
    """
    members = members.join(texts.select("uid", "n"), "uid")
    blocks = members.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"), "n")
    units = blocks.where("blocks = 1").agg(F.ceil(F.sum("n") / (2 * BLOCK))).first()[0] or 1
    met = members.select("key", "uid").join(blocks.select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("uid"), "blocks"))
    met = met.select("key", "uid", "blocks", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    alone = F.col("blocks") == 1
    unit = F.when(alone, F.pmod(F.xxhash64("key"), F.lit(units))).otherwise(F.col("key")).alias("unit")
    i, j = (F.when(alone, F.lit(-1)).otherwise(f("own", "other")).alias(n) for n, f in (("i", F.least), ("j", F.greatest)))

    def compare(table: pa.Table) -> pa.Table:
        uid, key = table["uid"].to_numpy(), np.unique(table["key"].to_numpy(), return_inverse=True)[1]
        runs = list(char_sets(table["line"].combine_chunks(), SHINGLE))
        flat, sizes = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        flat = mix(flat + np.repeat(key.astype(np.uint64) << np.uint64(52), sizes))  # lines of different keys have nothing in common
        found = similar(flat, sizes, np.arange(len(uid)), np.arange(len(uid)), similarity)
        return pa.table({"a": pa.array([int(uid[i]) for i, _ in found], pa.int64()), "b": pa.array([int(uid[j]) for _, j in found], pa.int64())})

    return met.select("key", "uid", unit, i, j).join(texts.select("uid", "line"), "uid").groupBy("unit", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _line_texts(wanted: DataFrame, hashed: DataFrame) -> DataFrame:
    """``uid, line`` for ``wanted(uid, h1, h2)``: lines whose hash may be wanted are met by it."""
    bitmap = _bitmap(wanted, "h1")

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(_set(bitmap, h.to_numpy()))

    some = hashed.select("h1", "h2", "line").where(maybe("h1"))
    return some.join(wanted, ["h1", "h2"]).groupBy("uid").agg(F.first("line").alias("line"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, lines_out: str = "n_lines", kept_out: str = "n_kept") -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` reduced to the lines that stay, and ``lines_out``, ``kept_out`` (counts of lines that aren't blank)."""
    keep = first_lines(docs, id_col, text_col, similarity).select(F.col("id").alias("_key"), F.col("th").alias("_th"), F.col("keep").alias("_keep"))
    packed = docs.select(F.struct("*").alias("_row"), _key(id_col).alias("_key"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_th"))
    met = packed.join(keep, ["_key", "_th"], "left")
    once = F.row_number().over(W.partitionBy("_key", "_th").orderBy(F.lit(1)))
    none, held = F.array().cast("array<int>"), F.col(f"_row.`{text_col}`")
    met = met.withColumn("_keep", F.when(once == 1, F.coalesce("_keep", none)).otherwise(none))
    met = met.withColumn("_all", F.split(F.coalesce(held.cast("string"), F.lit("")), "\n"))
    met = met.withColumn("_lines", F.expr(r"cast(size(filter(_all, x -> x rlike '\\S')) as bigint)")).withColumn("_kept", F.size("_keep").cast("long"))
    left = F.expr(r"array_join(filter(_all, (x, i) -> not (x rlike '\\S') or array_contains(_keep, i)), '\n')")
    text = F.when((F.col("_lines") == F.col("_kept")) | held.isNull(), held).otherwise(left)
    columns = [(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c not in (lines_out, kept_out)]
    return met.select(*columns, F.col("_lines").alias(lines_out), F.col("_kept").alias(kept_out))
