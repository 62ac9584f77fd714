"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, by exclusive-or and bit counts in numpy. A tile holds
fingerprints with the same population counts in each part of their 64 bits; two tiles whose counts differ by more than the radius,
summed over the parts, can't hold a pair within the radius and are never compared. A tile beyond ``BLOCK``
fingerprints is cut into blocks, so no task holds more than two blocks, and each pair of blocks returns
a spanning forest of its links instead of the links: no link is lost, and a group of n copies costs n rows, not n * n.
For removal (``keep_one``) the radius is wide, and links are verified by the exact similarity of the texts' sets of shingles.

Defined cases: words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words than
a shingle is one shingle; a text without words, or null, has fingerprint zero, which links like any other; repeated rows and
equal ids each get their row; a null id never names a component unless all its ids are null; a text
of any length is read whole; an empty table gives an empty result; other columns are kept (``keep_one``) or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize
from .shingles import mix, similar, word_sets

SEED, SHINGLE, RADIUS, BLOCK, ROWS = 42, 3, 2, 16384, 128
#: Near-duplicates for removal: words a shingle, longs a fingerprint, radius of the candidates (at similarity 0.8, 19 of the 128 bits differ, give or take 4),
#: least similarity, and bytes of text that a block holds, about.
WIDE, LONGS, FAR, SIMILARITY, BYTES = 5, 2, 28, 0.8, 1 << 21
#: For a wide radius: blocks that the fingerprints are cut into, about, and the largest of them. Each block is sent once for every block, so larger blocks send less. ``COLUMNS``: of a comparison that stays in the cache.
BLOCKS, FAR_BLOCK, COLUMNS = 24, 65536, 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits over the XXH64 of all shingles, repeats included; as a signed integer."""
    words = (text or b"").lower().split()
    n = max(len(words) - shingle + 1, 1 if words else 0)
    if not n:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones, hash_of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        some = np.array([hash_of(whole[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``, the fingerprint as a long. The Arrow function sees the text column alone."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return docs.withColumn(out, of(F.col(text_col).cast("string")))


def wide(flat: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of ``words`` times 64 majority bits, one row for each set of hashes; ``flat`` has the sets one after the other. An empty set has zeros."""
    out = np.zeros((len(counts), words), np.uint64)
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    for w in range(words if len(some) else 0):
        bits = np.unpackbits(mix(flat + np.uint64((w + 1) << 52)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some, w] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_wide(docs: DataFrame, text_col: str, out: str, shingle: int = WIDE, words: int = LONGS) -> DataFrame:
    """Adds ``out``: the fingerprint of the set of shingles, as ``words`` longs. The Arrow function sees the text column alone."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        found = [wide(flat, counts, words) for flat, counts in word_sets(texts, shingle)]
        flat = np.concatenate([np.zeros((0, words), np.uint64), *found]).view(np.int64).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32)), pa.array(flat))

    return docs.withColumn(out, of(F.col(text_col)))


def _forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius: of x with y (numbered on from x), or within x. A row is one fingerprint."""
    both = x if y is None else np.concatenate([x, y])
    label, first = np.arange(len(both)), 0 if y is None else len(x)
    for at in range(0, len(x), ROWS):
        rows = x[at : at + ROWS]
        skip = at if y is None else 0
        near = np.empty((len(rows), len(both) - first - skip), bool)
        for c in range(0, near.shape[1], COLUMNS):
            them = both[first + skip + c : first + skip + min(c + COLUMNS, near.shape[1])]
            apart = np.bitwise_count(rows[:, None, 0] ^ them[None, :, 0])
            for w in range(1, x.shape[1]):
                apart += np.bitwise_count(rows[:, None, w] ^ them[None, :, w])
            np.less_equal(apart, radius, out=near[:, c : c + COLUMNS])
        if y is None:
            near[np.arange(len(rows)), np.arange(len(rows))] = False
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            of = label[np.append(np.flatnonzero(near[i]) + first + skip, at + i)]
            low = of.min()
            if (of != low).any():
                label[np.isin(label, of)] = low
    far = np.flatnonzero(label != np.arange(len(both)))
    return list(zip(far.tolist(), label[far].tolist(), strict=True))


def _neighbours(key: tuple[int, ...], radius: int) -> Iterator[tuple[int, ...]]:
    if not key:
        yield ()
        return
    for d in range(-radius, radius + 1):
        for rest in _neighbours(key[1:], radius - abs(d)):
            yield (key[0] + d, *rest)


def _keys(parts: int) -> Column:
    """The population counts of the parts of a fingerprint ``fp``: of the whole, or of the parts of its one long. No parts: one tile of all."""
    if parts == 0:
        return F.array(F.lit(0))
    if parts == 1:
        return F.expr("array(aggregate(fp, 0, (n, x) -> n + bit_count(x)))")
    width = 64 // parts
    return F.array(*[F.expr(f"bit_count(shiftrightunsigned(fp[0], {width * i}) & {(1 << width) - 1}L)") for i in range(parts)])


def links(prints: DataFrame, radius: int = RADIUS, parts: int | None = None, block: int | None = None) -> DataFrame:
    """``a, b``: enough pairs of nodes within the radius to connect whatever is connected. ``prints`` holds ``node`` (long) and ``fp`` (array of longs).

    Without ``parts``, fingerprints of one long are cut into as many parts as make the largest tile a few blocks. Where the radius is wide, nearly all tiles are
    neighbours: there is one tile, in ``BLOCKS`` blocks or as many as keep them within ``FAR_BLOCK``. The driver gets the size of every tile: at most (64 / parts + 1) ** parts numbers, 83521 for four parts.
    """

    def compare(table: pa.Table) -> pa.Table:
        nodes = [np.array(v, np.int64) for v in table["nodes"].to_pylist()]
        sides = [np.array(v, np.int64).view(np.uint64).reshape(len(n), -1) for v, n in zip(table["fps"].to_pylist(), nodes, strict=True)]
        found = _forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
        of = np.concatenate(nodes).tolist()
        return pa.table({"a": pa.array([of[i] for i, _ in found], pa.int64()), "b": pa.array([of[j] for _, j in found], pa.int64())})

    return dealt(prints, radius, parts, block).groupBy("unit").applyInArrow(compare, "a bigint, b bigint")


def dealt(prints: DataFrame, radius: int, parts: int | None = None, block: int | None = None) -> DataFrame:
    """``unit, nodes, fps``: the blocks of each comparison, two or (a block with itself) one."""
    sizes: dict[tuple[int, ...], int] = {}
    for parts in (parts,) if parts else (2, 4) if radius <= 4 else (0,):  # noqa: B020
        sizes = {tuple(r[0]): r[1] for r in prints.groupBy(_keys(parts).alias("key")).count().collect()}
        if max(sizes.values(), default=0) <= 4 * (block or BLOCK):
            break
    if block is None:
        block = BLOCK if parts else min(max(sum(sizes.values()) // BLOCKS, 1024), FAR_BLOCK)
    blocks = {k: -(-n // block) for k, n in sizes.items()}
    several = {k: n for k, n in blocks.items() if n > 1}
    batch_units = max(1, 16 * BLOCK // max(block, BLOCK))
    cut = F.lit(1)
    keyed = prints.select("node", "fp", _keys(parts).alias("key"))
    if several:
        named = F.create_map(*[x for k, n in several.items() for x in (F.lit(".".join(map(str, k))), F.lit(n))])
        cut = F.coalesce(F.element_at(named, F.concat_ws(".", F.col("key").cast("array<string>"))), F.lit(1))
    packed = keyed.withColumn("no", F.pmod(F.xxhash64("node"), cut).cast("int")).groupBy("key", "no").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
    packed = packed.select("key", "no", F.col("m.node").alias("nodes"), F.flatten("m.fp").alias("fps"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (key, no) in enumerate(zip(batch["key"].to_pylist(), batch["no"].to_pylist(), strict=True)):
                me = (tuple(key), no)
                units = []
                for other in _neighbours(me[0], radius):
                    for their in range(blocks.get(other, 0)):
                        a, b = sorted([me, (other, their)])
                        units.append(f"{a[0]}{a[1]}/{b[0]}{b[1]}")
                own = [batch[c].slice(i, 1).cast(pa.list_(pa.int64())) for c in ("nodes", "fps")]
                for at in range(0, len(units), batch_units):
                    some = units[at : at + batch_units]
                    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.concat_arrays([c] * len(some)) for c in own)], ["unit", "nodes", "fps"])

    return packed.mapInArrow(pairs, "unit string, nodes array<bigint>, fps array<bigint>")


def components(docs: DataFrame, id_col: str, fp_col: str, radius: int = RADIUS) -> DataFrame:
    """``fp, component_id``: per distinct fingerprint the smallest id of its component. ``docs`` must be cheap to read twice."""
    prints = materialize(docs.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "prints")
    roots = connected_components(links(prints.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), radius), "simhash")
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per input row: id, ``fp`` (long) and ``component_id``, the smallest id reachable over links within the radius."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    printed = materialize(with_fingerprint(slim, "text", "own").select("id", "own"), "simhash-docs")
    named = components(printed, "id", "own", radius)
    return printed.join(named, F.col("own") == F.col("fp")).select(F.col("id").alias(id_col), F.col("own").alias("fp"), "component_id")


def verified_links(entries: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """``a, b``: enough links to connect all entries (uid, fp, size) whose fingerprints lie within the radius and whose sets of shingles are as similar as asked.

    Entries connected within the radius are candidates of each other. Their texts (uid, text) meet in blocks of bounded size, each with each, and
    every pair within the radius is verified by the exact Jaccard similarity unless it is connected already.
    """
    roots = connected_components(links(entries.select(F.col("uid").alias("node"), "fp"), radius), "simhash-near")
    near = entries.join(roots.withColumnRenamed("root", "group"), F.col("uid") == F.col("node")).select("uid", "fp", "size", "group")
    total = near.groupBy("group").agg(F.ceil(F.sum("size") / BYTES).cast("int").alias("blocks"))
    met = near.join(total, "group").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    met = met.select("group", "uid", "fp", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    units = met.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "fp").join(texts, "uid")

    def compare(table: pa.Table) -> pa.Table:
        uid, runs = table["uid"].to_numpy(), list(word_sets(table["text"].combine_chunks(), shingle))
        prints = np.array(table["fp"].to_pylist(), np.int64).view(np.uint64)
        found = similar(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]), uid, np.arange(len(uid)), similarity, prints, radius)
        return pa.table({"a": pa.array([int(uid[i]) for i, _ in found], pa.int64()), "b": pa.array([int(uid[j]) for _, j in found], pa.int64())})

    return units.groupBy("group", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE, radius: int = FAR, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates: the row with the smallest id stays (nulls last), of equal ids any one.

    Fingerprints of the sets of shingles (``LONGS`` longs) lie within the radius, and links are verified by the exact similarity of the sets. Texts without words are copies of each other.
    """
    text = F.col(f"`{text_col}`").cast("string")
    packed = docs.select(F.struct("*").alias("doc"), F.col(f"`{id_col}`").alias("id"), F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("").alias("text"))
    whole = with_wide(packed, "text", "fp", shingle).withColumn("row", F.monotonically_increasing_id())
    whole = materialize(whole.select("doc", "id", "fp", "row", F.xxhash64("text").alias("mark"), (F.octet_length("text") + 1).alias("size")), "simhash-whole")
    slim = whole.select(F.struct(F.col("id").isNull().alias("n"), "id", "row").alias("o"), "fp", "mark", "size")
    entries = materialize(slim.groupBy("fp", "mark", "size").agg(F.min("o").alias("o")).withColumn("uid", F.col("o.row")), "simhash-entries")
    texts = whole.select(F.col("row").alias("uid"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    roots = connected_components(verified_links(entries, texts, shingle, radius, similarity), "simhash-groups")
    of = entries.select("uid", "o").join(roots, F.col("uid") == F.col("node"), "left")
    stays = of.groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    return whole.join(stays, "row", "left_semi").select("doc.*")
