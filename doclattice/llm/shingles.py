"""Sets of shingle hashes and their smallest members, for whole Arrow batches in numpy.

A shingle's hash is a polynomial over its symbols (code points or words, mixed to 64 bits), built for all places of a batch at once by doubling:
runs of 1, 2, 4, ... add up to the width. It is mixed again, so the order of hashes is as good as random and the smallest hashes of a set
are its MinHash signature. Sets keep 52 bits of each hash, in ascending order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = 0x9E3779B97F4A7C15
#: Symbols that are hashed at a time, and texts: their number has 12 bits in the keys that are sorted.
SYMBOLS, TEXTS = 1 << 15, 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(symbols: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` symbols, in order."""
    total, have = symbols[:0], 0
    run, size, power = symbols, 1, _BASE  # hashes of runs of ``size``; ``power`` is the base to the ``size``
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            n = max(len(symbols) - have - size + 1, 0)
            total = total[:n] * np.uint64(power) + run[have : have + n] if have else run[:n]
            have += size
        if width >> bit > 1:
            run = run[: max(len(run) - size, 0)] * np.uint64(power) + run[size:]
            size, power = 2 * size, power * power % (1 << 64)
    return mix(total)


def _hashes(symbols: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """52-bit hashes of all shingles of texts with ``sizes`` symbols, text by text, and their number in each. Fewer symbols than ``width`` are one shingle, ended by zeros."""
    if (sizes < width).any():
        room = np.maximum(sizes, width)
        laid = np.zeros(int(room.sum()), np.uint64)
        laid[np.repeat(np.cumsum(room) - room - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))] = symbols
        symbols, sizes = laid, room
    inside = np.ones(len(symbols), bool)
    for back in range(1, width):  # runs that would end in the next text
        inside[np.cumsum(sizes) - back] = False
    hashes = rolled(symbols, width)
    return hashes[inside[: len(hashes)]] >> np.uint64(12), sizes - width + 1


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts from their hashes, ascending, one after the other, and the size of each set."""
    keys = np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(52), counts) | hashes
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys & np.uint64((1 << 52) - 1), np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=len(counts))


def _sets(symbols: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return _distinct(*_hashes(symbols, sizes, width)) if len(sizes) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _smallest(symbols: np.ndarray, sizes: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` smallest members of each set, the number of them, and the number of shingles (repeats included)."""
    hashes, counts = _hashes(symbols, sizes, width)
    # hashes below a bound that about four times as many of a text fall under; texts that hold fewer different ones are sorted whole
    bound = (np.minimum(1.0, 4 * most / counts) * (1 << 52)).astype(np.uint64)
    low = hashes < np.repeat(bound, counts)
    ends = np.cumsum(counts)
    few, n = _distinct(hashes[low], np.add.reduceat(low, ends - counts, dtype=np.int64))
    short = np.flatnonzero((n < most) & (4 * most < counts))
    rank = np.arange(len(few)) - np.repeat(np.cumsum(n) - n, n)
    if not len(short):
        return few[rank < most], np.minimum(n, most), counts
    parts = np.split(few, np.cumsum(n)[:-1])
    for i in short.tolist():
        parts[i] = np.unique(hashes[ends[i] - counts[i] : ends[i]])
    parts = [x[:most] for x in parts]
    return np.concatenate(parts), np.array([len(x) for x in parts]), counts


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, stop) that are bounded in number and, but for single texts beyond it, in symbols."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        stop = min(max(int(np.searchsorted(ends, before + SYMBOLS, side="right")), first + 1), first + TEXTS)
        yield first, stop
        first = stop


def _points(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(mixed code points, sizes) of runs of texts. A null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, stop in _runs(sizes):
        points = np.frombuffer("".join(texts.slice(first, stop - first).to_pylist()).encode("utf-32-le", "replace"), np.uint32)
        yield mix(points + np.uint64(_BASE)), sizes[first:stop]


def char_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, set sizes) of runs of texts by shingles of ``width`` code points."""
    for symbols, sizes in _points(texts):
        yield _sets(symbols, sizes, width)


def char_sketches(texts: pa.Array, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smallest hashes, their numbers, numbers of shingles) of runs of texts by shingles of ``width`` code points."""
    for symbols, sizes in _points(texts):
        yield _smallest(symbols, sizes, width, most)


def word_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, set sizes) of runs of texts by shingles of ``width`` words: what stands between ASCII white space, A-Z in lower case. No words: the empty set."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    of, words = of[full.to_numpy(zero_copy_only=False).astype(bool)], words.filter(full).dictionary_encode()
    names = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))
    symbols, sizes = names[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64), np.bincount(of, minlength=len(texts))
    ends = np.cumsum(sizes)
    for first, stop in _runs(sizes):
        own = sizes[first:stop]
        hashes, counts = _sets(symbols[(ends[first] - own[0]) if len(own) else 0 : ends[stop - 1]], own, width)
        yield (hashes, counts) if own.all() else (hashes[np.repeat(own > 0, counts)], np.where(own > 0, counts, 0))


def arrow_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One list of longs for each text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def similar(flat: np.ndarray, sizes: np.ndarray, root: np.ndarray, left: np.ndarray, similarity: float, prints: np.ndarray | None = None, radius: int = 64) -> list[tuple[int, int]]:
    """Links that connect all sets with a Jaccard similarity of ``similarity`` or more: pairs (i, j), i from ``left``, of sets with different roots.

    Exact: with the members of every set ordered from the rarest to the most frequent, two sets that are so similar share one of the first
    ``size - similarity * size + 1`` members of both. Such pairs, if their sizes allow the similarity (and fingerprints lie within the radius, where ``prints`` are
    given), are counted out unless links found before connect the two. ``flat`` has the sets one after the other.
    """
    ids = np.unique(flat, return_inverse=True)[1]
    rank = np.empty(int(ids.max(initial=-1)) + 1, np.int64)
    rank[np.argsort(np.bincount(ids, minlength=len(rank)), kind="stable")] = np.arange(len(rank))
    of, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    token = np.sort(of << 40 | rank[ids]) & ((1 << 40) - 1)
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    head = np.arange(len(token)) - starts[of] < first[of]
    holders = of[head][np.argsort(token[head], kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(token[head], minlength=len(rank)))])
    label, held, found = np.unique(root, return_inverse=True)[1], np.zeros(len(rank), bool), []
    for i in left.tolist():
        mine = token[starts[i] : starts[i] + sizes[i]]
        rare = mine[: first[i]]
        met = holders[_ranges(begin[rare], begin[rare + 1] - begin[rare])]
        met = np.unique(met[label[met] != label[i]])
        met = met[(sizes[met] >= similarity * sizes[i] - 1e-9) & (sizes[i] >= similarity * sizes[met] - 1e-9)]
        if prints is not None:
            met = met[np.bitwise_count(prints[met] ^ prints[i]).sum(axis=1) <= radius]
        if not len(met):
            continue
        held[mine] = True
        for part in np.split(met, np.flatnonzero(np.diff(np.cumsum(sizes[met]) >> 22)) + 1):
            both = np.add.reduceat(held[token[_ranges(starts[part], sizes[part])]].astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for j in part[both >= similarity * (sizes[part] + sizes[i] - both) - 1e-9].tolist():
                if label[j] != label[i]:
                    found.append((i, j))
                    label[label == label[j]] = label[i]
        held[mine] = False
    return found


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start .. start + size - 1`` of all, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
