"""SimHash, winnowing, lines and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from doclattice.llm.lines import SHINGLE, SIMILARITY, dedup_lines
from doclattice.llm.neighbours import with_next
from doclattice.llm.queries import op3, op7
from doclattice.llm.shared import connected_components
from doclattice.llm.shingles import char_sets, char_sketches, similar, word_sets
from doclattice.llm.simhash import BLOCKS, FAR, _forest, dealt, fingerprint, keep_one, links, near_duplicates
from doclattice.llm.winnow import GRAM, WINDOW, add_marks, edit_start, spliced
from doclattice.llm.winnow import fingerprint as winnow


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(5, 5), (3, 9), (9, 3), (7, 3)]])
def test_components(spark, edges):
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.root(x) for e in edges for x in e}


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Two Words", "a b c", "É a b ÀB c\x0bd " * 40])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) % 2**64 == brute_fp(text)


def test_forest_keeps_all_links():
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    x = np.array(sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(12)}), np.uint64)
    a, b = Sets(), Sets()
    for i in range(len(x)):
        for j in range(i):
            if int(x[i] ^ x[j]).bit_count() <= 2:
                a.join(int(x[i]), int(x[j]))
    half, y = len(x) // 2, x[:, None]
    for part, found in ((x[:half], _forest(y[:half], None, 2)), (x[half:], _forest(y[half:], None, 2)), (x, _forest(y[:half], y[half:], 2))):
        for p, q in found:
            b.join(int(part[p]), int(part[q]))
    assert [a.root(int(v)) for v in x] == [b.root(int(v)) for v in x]


@pytest.mark.parametrize("parts, block", [(2, 16384), (2, 7), (4, 5), (1, 20)])
def test_tiles(spark, parts, block):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(15)]
    prints = sorted({(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) - 2**63 for b in base for _ in range(10)})
    want, got = Sets(), Sets()
    for n, i in enumerate(prints):
        for j in prints[:n]:
            if ((i ^ j) & (2**64 - 1)).bit_count() <= 2:
                want.join(i, j)
    for e in links(spark.createDataFrame([(p, [p]) for p in prints], "node long, fp array<long>"), parts=parts, block=block).collect():
        got.join(e["a"], e["b"])
    assert [want.root(p) for p in prints] == [got.root(p) for p in prints]


def test_wide_radius_sends_few_copies(spark):
    """Each fingerprint is sent once for every block, not for every population count; no link is lost."""
    r = np.random.default_rng(5)
    base = r.integers(-(2**63), 2**63 - 1, (30000, 2))
    base[1::10] = base[::10] ^ (np.int64(1) << r.integers(0, 27, (3000, 2)))
    base[2::30] = base[::30] ^ np.int64((1 << 15) - 1)  # 30 bits: beyond the radius
    base[3::30] = base[::30] ^ np.int64((1 << 14) - 1)
    prints = spark.createDataFrame(list(enumerate(base.tolist())), "node long, fp array<long>").repartition(8).cache()
    sent = dealt(prints, FAR).select("nodes").rdd.map(lambda x: len(x[0])).sum()
    assert sent <= (BLOCKS + 3) * len(base)
    want, got = Sets(), Sets()
    for i in range(0, len(base), 200):
        apart = np.bitwise_count((base[i : i + 200, None] ^ base[None]).view(np.uint64)).sum(axis=2)
        for a, b in np.argwhere(apart <= FAR).tolist():
            want.join(a + i, b)
    for e in links(prints, FAR).collect():
        got.join(e["a"], e["b"])
    assert [want.root(i) for i in range(len(base))] == [got.root(i) for i in range(len(base))] and len({want.root(i) for i in range(len(base))}) < 27000


def test_op3(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_fp(t) for i, t in docs.items()}
    sets, ids = Sets(), list(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                sets.join(i, j)
    got = op3.query(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", sets.root(i)) for i in ids}


def test_simhash_odd(spark, odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "7", "9", "None"]
    assert kept.join(odd, "doc_id").count() > 0
    assert near_duplicates(none).count() == keep_one(none).count() == 0


def brute_winnow(text):
    grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)] or [text]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) & 0xFFFFFFFF for g in grams]
    windows = [range(i, i + WINDOW) for i in range(len(h) - WINDOW + 1)] or [range(len(h))]
    return sorted({min(((h[i], -i) for i in w)) for w in windows}, key=lambda x: -x[1])


@pytest.mark.parametrize("text", ["", "short", "a" * 60, "naïve \U0001f600 \U0001d4db text with several words and a long enough tail to have windows", "abcabcabc" * 9])
def test_winnow(spark, text):
    got = winnow(spark.createDataFrame([(text,)], "text string")).first()["winnowed"]
    assert [(m["hash"], -m["pos"]) for m in got] == brute_winnow(text)


def test_winnow_odd(spark, odd, none, tmp_path):
    got = winnow(odd.withColumnsRenamed({"row": "_all", "key": "_m"}))
    assert got.columns == [*odd.withColumnsRenamed({"row": "_all", "key": "_m"}).columns, "winnowed"] and got.count() == odd.count()
    assert {r["winnowed"][0]["pos"] for r in got.where("text is null or text = ''").collect()} == {0}
    assert winnow(none).count() == 0
    for name, docs, n in (("odd", odd, odd.count()), ("none", none, 0)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert op7.query(spark, f"{tmp_path}/{name}").count() == n


def test_spliced(spark):
    """Marks of an edited text, spliced from those of its original, are those of the text itself."""
    r = random.Random(8)
    rows = []
    for n in [*range(0, 70), 150, 300]:
        text = "".join(r.choice("ab \U0001f600") for _ in range(n))
        kept = n - n // 2
        rows.append((n, text, kept, text[:kept] + "".join(r.choice("abc") for _ in range(r.randrange(n // 2 + 1)))))
    df = add_marks(add_marks(spark.createDataFrame(rows, "n int, text string, kept int, edited string"), "text", "marks"), "edited", "want")
    df = add_marks(df.selectExpr("*", f"substring(edited, {edit_start('kept')} + 1, char_length(edited)) as tail"), "tail", "tail_marks")
    assert [r["n"] for r in df.select("n", spliced("marks", "tail_marks", "kept").alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_next_rows(spark, monkeypatch):
    import doclattice.llm.neighbours as n

    monkeypatch.setattr(n, "ROWS", 3)
    r = random.Random(4)
    rows = [(r.choice([None, *range(30)]), r.randrange(-(2**62), 2**62)) for _ in range(60)]
    got = with_next(spark.createDataFrame(rows, "id long, tie long").repartition(5), "id", "tie", {"next_id": "id", "next_tie": "tie"}).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -x[1]))
    assert sorted(map(str, [(*order[i], *order[(i + 1) % 60]) for i in range(60)])) == sorted(str(tuple(x)) for x in got)


def test_op7(spark, sf_dir):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in op7.query(spark, sf_dir).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(docs[i]) // 2
        edited = docs[i][: len(docs[i]) - half] + docs[j][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other = brute_winnow(docs[i]), brute_winnow(edited)
        for marks, name in ((own, "fingerprint"), (other, "edited_fingerprint")):
            said = ",".join(str(h << 31 | 2**31 - 1 + at) for h, at in marks)
            assert got[i][name] == hashlib.sha256(said.encode()).hexdigest()
        a, b, c = ({h for h, _ in m} for m in (own, other, brute_winnow(docs[j])))
        assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 1e-9
        assert abs(got[i]["near_next"] - len(a & c) / len(a | c)) < 1e-9


def test_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    lines = [(i, n, x) for i, t in sorted((r["doc_id"], r["text"]) for r in docs.collect()) for n, x in enumerate(t.split("\n")) if x.strip()]
    sets, shingles = Sets(), {}
    for _, _, x in lines:
        shingles.setdefault(x, {x[j : j + SHINGLE] for j in range(len(x) - SHINGLE + 1)} or {x})
    distinct = list(shingles)
    index = {}
    for n, x in enumerate(distinct):
        near = {m for s in shingles[x] for m in index.get(s, ())}
        for m in near:
            y = distinct[m]
            both = len(shingles[x] & shingles[y])
            if both / (len(shingles[x]) + len(shingles[y]) - both) >= SIMILARITY:
                sets.join(m, n)
        for s in shingles[x]:
            index.setdefault(s, []).append(n)
    number, seen, want = {x: n for n, x in enumerate(distinct)}, set(), {}
    for i, _, x in lines:
        root = sets.root(number[x])
        want[i] = want.get(i, 0) + (root not in seen)
        seen.add(root)
    assert {i: r["n_kept"] for i, r in got.items()} == {i: want.get(i, 0) for i in got}


def grams_of(text, size=10):
    return {text[i : i + size] for i in range(len(text) - size + 1)} or {text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_sets():
    texts = ["", "a", "äbc" * 5, "hello world this is", "x" * 50, None, "\U0001f600" * 4 + "0123456789", "a\nb" * 900]
    runs = list(char_sets(pa.array(texts), 10))
    whole, sizes = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    assert sizes.tolist() == [len(grams_of(t or "")) for t in texts]
    sets = [x.tolist() for x in np.split(whole, np.cumsum(sizes)[:-1])]
    assert all(x == sorted(set(x)) for x in sets)
    flat, few, _ = next(char_sketches(pa.array(texts), 10, 4))
    assert [x.tolist() for x in np.split(flat, np.cumsum(few)[:-1])] == [x[:4] for x in sets]
    words = ["a b c d e f", " A  b\tc\nd e f ", "", " \n", None, "one", "a b c d e g", "é É a b c d"]
    runs = list(word_sets(pa.array(words), 5))
    whole, sizes = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    assert sizes.tolist() == [2, 2, 0, 0, 0, 1, 2, 2]
    found = [set(x.tolist()) for x in np.split(whole, np.cumsum(sizes)[:-1])]
    assert found[0] == found[1] and len(found[0] & found[6]) == 1


def test_similar_keeps_all_links():
    r = random.Random(9)
    sets = [r.sample(range(2000), r.randint(1, 60)) for _ in range(40)]
    for _ in range(160):
        sets.append([x if r.random() < 0.95 else r.randrange(2000) for x in r.choice(sets)])
    sets = [sorted(set(s)) for s in sets]
    flat, sizes = np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets])
    want, got = Sets(), Sets()
    for i in range(len(sets)):
        for j in range(i):
            if jaccard({*sets[i]}, {*sets[j]}) >= 0.8:
                want.join(i, j)
    found = similar(flat, sizes, np.arange(len(sets)), np.arange(len(sets)), 0.8)
    for i, j in found:
        assert jaccard({*sets[i]}, {*sets[j]}) >= 0.8
        got.join(i, j)
    assert [want.root(i) for i in range(len(sets))] == [got.root(i) for i in range(len(sets))]
    assert len(found) == len(sets) - len({want.root(i) for i in range(len(sets))})


@pytest.fixture(scope="module")
def planted():
    """Isolated pairs of lines, 150 for each length, with edits at the first character, before, behind and within; those with similarity 0.8 or more count."""
    r, rows = random.Random(21), []
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    for size in (30, 45, 60, 90, 150, 250, 400):
        for k in range(150):
            line = " ".join(word() for _ in range(size // 3))[:size].strip()
            at, copies = r.randrange(len(line)), []
            while not copies:
                copies = [e for e in (["#" + line[1:], word() + " " + line, line + " " + word(), line[:at] + "#" + line[at + 1 :]][k % 4 :] + [line + "#"]) if jaccard(grams_of(line), grams_of(e)) >= 0.8]
            rows.append((size, line, copies[0]))
    return rows


def test_lines_planted_pairs(spark, planted):
    rows = [(2 * n + side, pair[side]) for n, (_, *pair) in enumerate(planted) for side in (0, 1)]
    kept = {r["doc_id"]: r["n_kept"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[2 * n] == 1 for n in range(len(planted)))
    for size in sorted({p[0] for p in planted}):
        mine = [kept[2 * n + 1] == 0 for n, p in enumerate(planted) if p[0] == size]
        assert sum(mine) >= 0.98 * len(mine), (size, sum(mine), len(mine))


def test_lines_chains(spark):
    """Windows of 200 characters, each moved by 5: neighbours are alike, and each group is one component."""
    r, rows = random.Random(22), []
    for g in range(12):
        text = "".join(r.choice("abcdefgh ijklmnop") for _ in range(450))
        rows += [(g * 50 + i, text[5 * i : 5 * i + 200].replace(" ", "_")) for i in range(50)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got if x["n_kept"]) == [g * 50 for g in range(12)]


def test_lines_short_sets(spark):
    """Lines with few shingles always meet."""
    lines = ["abcdefghijklm", "abcdefghijklmn", "xbcdefghijklmn", "qwertyuiopas", "qwertyuiopasd", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "0123456789abcde", "0123456789abcdef"]
    got = {r["doc_id"]: r["n_kept"] for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    sets = Sets()
    for i in range(len(lines)):
        for j in range(i):
            if jaccard(grams_of(lines[i]), grams_of(lines[j])) >= 0.8:
                sets.join(i, j)
    assert {i for i, n in got.items() if n} == {sets.root(i) for i in range(len(lines))}


def test_lines_odd(spark, odd, none):
    got = dedup_lines(odd, lines_out="n1", kept_out="n2").collect()
    assert len(got) == odd.count()
    assert sorted(r["n2"] for r in got if r["doc_id"] in (4, 8)) == [0, 0, 2]
    assert {r["text"] for r in got if r["doc_id"] == 5} == {None}
    assert {r["text"] for r in got if r["doc_id"] == 2} == {" \n\t \n"}
    assert dedup_lines(none).count() == 0
    clash = dedup_lines(spark.createDataFrame([(1, "a line", 7, 8, 9)], "doc_id long, text string, n_lines int, uid int, band int"))
    assert clash.columns == ["doc_id", "text", "uid", "band", "n_lines", "n_kept"] and clash.first()["n_lines"] == 1


def test_lines_one_character(spark):
    """One character in mid-line is 10 shingles, whatever the module says: a line of 105 characters is still like its copy."""
    r = random.Random(3)
    line = "".join(r.choice("abcdefgh ") if i % 5 else " " for i in range(105)).replace("  ", " x")[:105]
    copy = line[:52] + "Z" + line[53:]
    grams = [{x[i : i + 10] for i in range(len(x) - 9)} for x in (line, copy)]
    assert 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.82
    got = dedup_lines(spark.createDataFrame([(1, line), (2, copy)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_kept"] for r in got} == {1: 1, 2: 0}


def test_lines_wide_family_without_broadcast(spark, monkeypatch):
    """A family that is gone through band by band, where its tables are too large to be broadcast."""
    import doclattice.llm.lines as m

    monkeypatch.setattr(m, "BLOCK", 3000)
    monkeypatch.setattr(m, "FEW", 2)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join([*words[: 1 + i % 39], f"n{i:04d}", *words[1 + i % 39 :]])) for i in range(80)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = m.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [x["doc_id"] for x in got if x["n_kept"]] == [0]


def test_pipeline_lines_wide_family_without_broadcast(spark, sf_dir, monkeypatch):
    """The second stage of the pipeline, on the same kind of family."""
    import corpus_pipeline
    import doclattice.llm.lines as m

    monkeypatch.setattr(m, "BLOCK", 3000)
    monkeypatch.setattr(m, "FEW", 2)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join([*words[: 1 + i % 39], f"n{i:04d}", *words[1 + i % 39 :]]), 0) for i in range(80)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {x["doc_id"]: x["n_chars"] for x in got} == {i: len(t) if i == 0 else 0 for i, t, _ in rows}


@pytest.mark.parametrize("block, few", [(1 << 19, 8), (3000, 100), (3000, 2)])
def test_lines_edits_of_edits(spark, monkeypatch, block, few):
    """A group in which each line is an edit of another: components hang together by links between members that aren't heads."""
    import doclattice.llm.lines as m

    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "FEW", few)
    r, size = random.Random(2), 10
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    made = [[r.choice(vocabulary) for _ in range(40)]]
    while len(made) < 500:
        words = list(r.choice(made))
        for _ in range(r.randint(1, 3)):
            words[r.randrange(40)] = r.choice(vocabulary)
        made.append(words)
    texts = list(dict.fromkeys(" ".join(w) for w in made))
    grams = [{x[i : i + size] for i in range(len(x) - size + 1)} for x in texts]
    sets = Sets()
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both / (len(grams[i]) + len(grams[j]) - both) >= 0.8:
                sets.join(i, j)
    want = len({sets.root(i) for i in range(len(texts))})
    kept = sum(x["n_kept"] for x in m.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == want


def test_pipeline_near_copies(spark, odd, none):
    """The pipeline's stage takes five words and similarity 0.8: edited copies go, however far their fingerprints are."""
    import corpus_pipeline

    r = random.Random(5)
    rows, want = [], Sets()
    for k in range(12):
        words = [f"w{r.randrange(900)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 4, 6):
            copy = list(words)
            for at in r.sample(range(200), edits):
                copy[at] = f"e{r.randrange(900)}"
            rows.append((len(rows), " ".join(copy)))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8:
                want.join(i, j)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({want.root(i) for i in range(len(rows))})
    assert sorted(str(x["doc_id"]) for x in corpus_pipeline.near_duplicates(spark, odd, "").collect()) == ["1", "3", "4", "6", "7", "9", "None"]
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0
