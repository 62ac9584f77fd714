"""Language identification by a linear-chain conditional random field over words.

Every word of a line gets a label; its features are prefixes and suffixes of up to three bytes, byte n-grams of two and
three, hashed to one weight table, and its entries in the lexicon: the languages in whose training documents the word stands twice or more. Label-to-label transitions are
learned with the weights by the gradient of the log likelihood, from chains in which lines of
different languages follow one another, so that texts which switch language are labelled word by word. Forward-backward gives each word's
label distribution; a text's language is the label with the largest share of its words.

Defined cases: a text that is null or holds no letter is ``und`` with score 0; a text of any length is read whole, its lines
being the chains; repeated rows each get their row; a null language isn't learned from; with nothing to learn from, every text is
``und``; ties go to the label first in the alphabet; an empty table gives an empty result; other columns are kept, whatever their
names, but those named like the two outputs are replaced by them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, GRAMS = 18, (2, 3)
#: Bound of the training sample: documents of each language, whose whole texts are learned from.
SAMPLE_DOCS = 300
#: Weights of the hashed features: with more languages the table has fewer rows, so its size is bounded and no language is left out.
WEIGHTS = 1 << 24
EPOCHS, CHAINS_A_STEP, RATE, DECAY = 4, 64, 0.3, 1e-7
UNKNOWN = "und"


class Lexicon:
    """The training words, and for each the labels of the languages that use it."""

    def __init__(self, lines: list[tuple[int, int, list[str]]], least: int = 2):
        """From (label, document, words of a line); ``least`` documents of a language must hold a word."""
        held = Counter((w, y) for w, y, _ in {(w, y, d) for y, d, ws in lines for w in ws})
        pairs = sorted(p for p, n in held.items() if n >= least)
        self.words = pa.array(list(dict.fromkeys(w for w, _ in pairs)), pa.large_string())
        self.labels = np.array([y for _, y in pairs], np.int64)
        sizes = Counter(w for w, _ in pairs)
        self.ends = np.cumsum([0, *(sizes[w] for w in self.words.to_pylist())])

    def entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, label) for all entries of ``words``."""
        found = pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found >= 0)
        first, n = self.ends[found[at]], self.ends[found[at] + 1] - self.ends[found[at]]
        return np.repeat(at, n), self.labels[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def features(words: pa.Array, bits: int = BITS, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of distinct words: ids of all features one after the other, and where each word's begin. Every word has some. Lexicon entries come after the ``2 ** bits`` hashed ids."""
    data = words.cast(pa.binary())
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets -= offsets[0]
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(raw)) - offsets[word]
    left = size[word] - at
    mix = np.uint64(0x9E3779B97F4A7C15)

    def hashed(kind: int, n: int, where: np.ndarray) -> np.ndarray:
        h = np.full(len(where), kind * 0x1000193 + n, np.uint64)
        for j in range(n):
            h = (h ^ raw[where + j]) * mix
            h ^= h >> np.uint64(29)
        return (h * mix) >> np.uint64(64 - bits)

    found, of = [], []
    for n in GRAMS:
        where = np.flatnonzero(left >= n)
        found.append(hashed(1, n, where))
        of.append(word[where])
    for n in (1, 2, 3):
        short = np.flatnonzero(size >= n)
        found += [hashed(2, n, offsets[short]), hashed(3, n, offsets[short + 1] - n)]
        of += [short, short]
    if lexicon is not None:
        at, labels = lexicon.entries(words)
        found.append((labels + (1 << bits)).astype(np.uint64))
        of.append(at)
    ids, of = np.concatenate(found).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order], np.searchsorted(of[order], np.arange(len(size)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts in lower case, the line that holds each word, and the text that holds each line. Words without a letter are left out."""
    lines = pc.split_pattern(pc.utf8_lower(pc.fill_null(texts, "")), "\n")
    text_of_line = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    words = pc.utf8_split_whitespace(lines.flatten())
    line_of_word = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    flat = words.flatten()
    coded = flat.dictionary_encode()
    letters = pc.match_substring_regex(coded.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
    keep = letters[coded.indices.to_numpy()] if len(flat) else np.zeros(0, bool)
    return coded.filter(pa.array(keep)), line_of_word[keep], text_of_line


class Field:
    """Weights (features x labels), transitions (labels x labels), start scores and the lexicon. Hashed features come first, one row for each label's lexicon entry last."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: Lexicon | None = None):
        self.labels, self.weights, self.trans, self.start, self.lexicon = labels, weights.astype(np.float32), trans, start, lexicon
        self.bits = (len(weights) - len(labels)).bit_length() - 1

    def emissions(self, words: pa.Array) -> np.ndarray:
        ids, begin = features(words, self.bits, self.lexicon)
        return np.add.reduceat(self.weights[ids], begin, axis=0).astype(np.float64)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.labels)
        share = np.zeros((n, k))
        coded, line, text = split_words(texts)
        if len(coded) and k:
            index = coded.indices.to_numpy()
            used, index = np.unique(index, return_inverse=True)
            emit = self.emissions(coded.dictionary.take(pa.array(used)))[index]
            gamma = forward_backward(emit, line, self.trans, self.start, False)[0]
            for j in range(k):
                share[:, j] = np.bincount(text[line], gamma[:, j], n)
        total = share.sum(axis=1)
        best = share.argmax(axis=1) if k else np.zeros(n, int)
        some = total > 0
        score = np.where(some, share[np.arange(n), best] / np.where(some, total, 1), 0) if k else np.zeros(n)
        return [self.labels[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.clip(score, 0, 1)


def forward_backward(emit: np.ndarray, chain: np.ndarray, trans: np.ndarray, start: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the label distribution; expected transitions (if ``moves``); and the distribution at chain starts.

    ``chain`` numbers the chain of each word, ascending. All chains advance together, longest first, so
    that the words at one place are one matrix; messages are scaled to sum 1.
    """
    first = np.flatnonzero(np.diff(chain, prepend=-1))
    size = np.diff(np.append(first, len(chain)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # chains longer than each place
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = e[first] * np.exp(start - start.max())
    for t, n in enumerate(live.tolist()):
        if t:
            a = (a[:n] @ move) * e[first[:n] + t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[first[:n] + t] = a
    pairs = np.zeros_like(move)
    ones = np.ones(e.shape[1])
    b = np.empty((0, e.shape[1]))
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        b = np.concatenate([b, np.broadcast_to(ones, (n - len(b), len(ones)))])
        at = first[:n] + t
        beta[at] = b
        if t:
            right = b * e[at]
            if moves:
                before = alpha[at - 1]
                scale = ((before @ move) * right).sum(axis=1)
                pairs += move * (before.T @ (right / scale[:, None]))
            b = right @ move.T
            b /= b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, pairs, gamma[first].sum(axis=0)


def train(lines: list[tuple[int, int, list[str]]], labels: list[str], seed: int = 5, epochs: int = EPOCHS) -> Field:
    """Weights from (label, document, words of one line). Each chain is one to three lines drawn at random; AdaGrad on its log likelihood."""
    r, k = np.random.default_rng(seed), len(labels)
    bits = max(8, min(BITS, (WEIGHTS // max(k, 1)).bit_length() - 1))
    w, trans, start = np.zeros(((1 << bits) + k, k), np.float32), np.zeros((k, k)), np.zeros(k)
    if k < 2 or not lines:
        return Field(labels if lines else [], w if lines else np.zeros((1 << bits, 0)), trans if lines else np.zeros((0, 0)), start if lines else np.zeros(0))
    lexicon = Lexicon(lines)
    flat = pa.array([x for _, _, ws in lines for x in ws]).dictionary_encode()
    ids, begin = features(flat.dictionary, bits, lexicon)
    end = np.append(begin[1:], len(ids))
    index, cut = flat.indices.to_numpy(), np.cumsum([0] + [len(ws) for _, _, ws in lines])
    ws, ts, ss = np.full(w.shape, 1e-3, np.float32), np.full(trans.shape, 1e-3), np.full(k, 1e-3)
    for _ in range(epochs):
        order, at = r.permutation(len(lines)), 0
        while at < len(order):
            chains, golds = [], []
            for _ in range(CHAINS_A_STEP):
                picked = order[at : at + int(r.integers(1, 4))]
                at += len(picked)
                if len(picked):
                    chains.append(np.concatenate([index[cut[i] : cut[i + 1]] for i in picked]))
                    golds.append(np.concatenate([np.full(cut[i + 1] - cut[i], lines[i][0]) for i in picked]))
            chain, gold = np.repeat(np.arange(len(chains)), [len(c) for c in chains]), np.concatenate(golds)
            used, inverse = np.unique(np.concatenate(chains), return_inverse=True)
            n = end[used] - begin[used]
            feats = ids[np.repeat(begin[used] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            emit = np.add.reduceat(w[feats], np.append(0, np.cumsum(n)[:-1]), axis=0).astype(np.float64)[inverse]
            gamma, pairs, begins = forward_backward(emit, chain, trans, start)
            size = len(gold)
            diff = -gamma
            diff[np.arange(size), gold] += 1
            same = chain[1:] == chain[:-1]
            held = np.zeros_like(trans)
            np.add.at(held, (gold[:-1][same], gold[1:][same]), 1)
            opens = np.bincount(gold[np.flatnonzero(np.diff(chain, prepend=-1))], minlength=k)
            per_word = np.stack([np.bincount(inverse, diff[:, j], len(used)) for j in range(k)], axis=1)
            each, where = np.unique(feats, return_inverse=True)
            of = np.repeat(np.arange(len(used)), n)
            grad = np.stack([np.bincount(where, per_word[of, j], len(each)) for j in range(k)], axis=1) / size - DECAY * w[each]
            ws[each] += grad**2
            w[each] += (RATE * grad / np.sqrt(ws[each])).astype(np.float32)
            for p, s, g in ((trans, ts, (held - pairs) / size), (start, ss, (opens - begins) / size)):
                s += g**2
                p += 0.1 * g / np.sqrt(s)
    return Field(labels, w, trans, start, lexicon)


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS) -> Field:
    """Learns from at most ``per_language`` documents of each language, chosen by a hash of the id where ``may_learn`` holds."""
    usable = docs.where(may_learn).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = sorted(((r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect()), key=lambda x: x[0])
    labels = [c[0] for c in counts]
    if not labels:
        return train([], [])
    # a uniform hash: the share below the cut holds about twice the documents wanted, and the exact number is taken from them
    low, span = -(2**63), 2**64
    cut = {lang: low + int(span * min(1.0, 2 * per_language / n)) - 1 for lang, n in counts}
    near = usable.where(F.col("h") <= F.element_at(F.create_map(*[x for lang, c in cut.items() for x in (F.lit(lang), F.lit(c))]), F.col("lang")))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                lines = [x.split() for x in text.lower().split("\n")]
                lines = [[x for x in ws if any(c.isalpha() for c in x)] for ws in lines]
                out.append(["\n".join(ws) for ws in lines if ws])
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["h"], pa.array(out, pa.list_(pa.string()))], ["lang", "h", "lines"])

    # about twice ``per_language`` small rows of each language come to the driver, which takes the first by hash
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = sorted((labels.index(r["lang"]), r["h"], r["lines"]) for r in once.mapInArrow(sample, "lang string, h long, lines array<string>").collect())
    taken = [0] * len(labels)
    lines = []
    for doc, (y, _, texts) in enumerate(rows):
        taken[y] += 1
        if taken[y] <= per_language:
            lines += [(y, doc, x.split("\n")) for x in texts]
    return train(lines, labels)


def predict(docs: DataFrame, field: Field, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its share of the words. The Arrow function sees the text alone."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for a in range(0, len(texts), 1024):
            found = field.predict(texts.slice(a, 1024))
            langs += found[0]
            scores += found[1].tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    given = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (lang_out, score_out)]
    return given.select("row", of("text").alias("found")).select(*held, F.col("found.lang").alias(lang_out), F.col("found.score").alias(score_out))
