import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import simhash
from siltstone.llm.components import components
from siltstone.llm.golay import near_indices

DOCS = "doc_id bigint, text string, fp string, component_id int"


def test_golay_neighbours():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3_000)
    near = near_indices(words)
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        theirs = near_indices(other)
        common = [set(a) & set(b) for a, b in zip(near.tolist(), theirs.tolist())]
        assert all(common)
        if flips == 1:
            assert all(b[0] in a for a, b in zip(near.tolist(), theirs.tolist()))
    assert {len(set(x)) for x in near.tolist()} == {1, 6}


def brute_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def random_docs(n, seed):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("alpha beta gamma Delta eps zeta eta theta".split()) + str(rnd.randrange(60)) for _ in range(rnd.choice([3, 30, 120]))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        if rnd.random() < 0.7 and w:
            w[rnd.randrange(len(w))] = "x" * rnd.randrange(1, 4)
        out.append((i * 3 + 1, rnd.choice([" ", "\t", "\x0b "]).join(w), "f", 1))
    return out + [(7_000, None, "f", 1), (7_001, "", "f", 1), (7_002, " \n", "f", 1), (None, "only", "f", 1), (out[0][0], out[0][1], "f", 1), (8_000, "  nbsp word", "f", 1)]


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_components_like_brute_force(spark, block):
    rows = random_docs(160, 4)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = simhash.simhash_components(docs, shingle=4, bits=4, block=block).collect()
    marks = [simhash.fingerprint((t or "").encode(), 4) for _, t, _, _ in rows]
    roots = brute_components(set(marks))
    least = {}
    for (i, *_), m in zip(rows, marks):
        if i is not None:
            least[roots[m]] = min(least.get(roots[m], i), i)
    want = sorted(((i, f"{m:016x}", least.get(roots[m])) for (i, *_), m in zip(rows, marks)), key=str)
    assert sorted(map(tuple, out), key=str) == want


def test_fingerprint_is_spark_xxhash64(spark):
    text = "The Quick brown fox\tjumps over 13 lazy dogs"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [r.h & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text.encode(), 4) == want
    assert simhash.fingerprint(b"one two", 4) == spark.range(1).select(F.xxhash64(F.lit("one two")).alias("h")).first().h & (1 << 64) - 1


def test_four_flipped_bits_share_a_narrow_key():
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 64, 4_000, np.uint64)
    other = fps.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    found = np.zeros(len(fps), bool)
    (where, keys), (there, theirs) = simhash.fuzzy_keys(fps), simhash.fuzzy_keys(other)
    both = set(zip(there.tolist(), theirs.tolist()))
    for w, k in zip(where.tolist(), keys.tolist()):
        found[w] |= (w, k) in both
    assert found.all() and keys.max() < 1 << 48 and len(np.unique(keys)) > 0.95 * len(keys) * 0.5


def test_empty_and_long(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    long = "word " * 300_000
    out = simhash.simhash_components(spark.createDataFrame([(1, long, "", 0), (2, long + "end", "", 0)], DOCS)).collect()
    assert {r.component_id for r in out} == {1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1_000, 1_000 + i) for i in range(1, 80)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {1_000 + i: 1_000 for i in range(80)}
    short = [e for e in edges if e[0] is None or e[0] > 990 or e[0] < 6]
    tables = {r.node: r.root for r in components(spark.createDataFrame(short, "src bigint, dst bigint"), small=0).collect()}
    assert tables == {i: 0 for i in range(7)} | {1_000 + i: 1_000 for i in range(80)}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def similar_ids(rows):
    """{id: least id reachable} by exact Jaccard similarity of five-word shingles, pair by pair."""

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def replaced(text, at):
    words = text.split()
    for k in at:
        words[k] = f"new{k}"
    return " ".join(words)


@pytest.mark.parametrize("held", [simhash.SHINGLES_HELD, 700])
def test_links_need_four_fifths_of_the_shingles(spark, held):
    rnd = random.Random(3)
    rows = []
    for k in range(12):
        text = " ".join(f"w{rnd.randrange(4_000)}" for _ in range(200))
        # apart: 5 words of 200 cost 25 of 196 shingles (0.77); close: 2 words (0.90)
        rows += [(10 * k, text), (10 * k + 1, replaced(text, range(20, 180, 33))), (10 * k + 2, replaced(text, (50, 150))), (10 * k + 3, text.upper())]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = similar_ids(rows)
    got = {r.id: r.component_id for r in simhash.similar_groups(docs, held=held).collect()}
    for k in range(12):
        assert got[10 * k + 1] == 10 * k + 1
    assert all(got[i] in (i, want[i]) for i in want)
    assert got[903] == 902 and got[901] == 900 and all(got[10 * k + 3] == 10 * k for k in range(12))
    import corpus_pipeline

    full = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, full, "").collect()}
    assert kept >= {10 * k + 1 for k in range(12)} and kept == {i for i in got if got[i] == i}


def test_similar_links_like_brute_force():
    rnd = random.Random(8)
    texts = []
    for _ in range(60):
        w = (rnd.choice(texts).split() if texts and rnd.random() < 0.7 else [f"v{rnd.randrange(900)}" for _ in range(rnd.choice([4, 40, 90]))])
        texts.append(replaced(" ".join(w), [rnd.randrange(len(w))] if rnd.random() < 0.8 else []))
    want = similar_ids(list(enumerate(texts)))
    links = simhash.similar_links(np.arange(60), [simhash.shingle_set(t.encode()) for t in texts])
    root = dict(enumerate(range(60)))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert root == want and len(links) == 60 - len(set(want.values()))


def test_scattered_edits_at_four_fifths_are_found(spark):
    rnd = random.Random(21)
    rows = []
    for k in range(60):
        text = " ".join(f"w{rnd.randrange(4_000)}" for _ in range(200))
        rows += [(2 * k, text), (2 * k + 1, replaced(text, rnd.sample(range(200), rnd.choice([3, 4]))))]
    want = similar_ids(rows)
    assert sum(want[2 * k + 1] == 2 * k for k in range(60)) > 50
    got = {r.id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_all_pairs_of_a_table_like_brute_force(spark):
    """All documents of a table, pair by pair; exact copies of shingle sets are one set, so they don't help the recall."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(simhash.shingle_set((t or "").encode()).tolist()), []).append(i)
    for ids in sets.values():
        assert len({got[i] for i in ids}) == 1
    at = {}
    for k, s in enumerate(sets):
        for h in s:
            at.setdefault(h, []).append(k)
    shared = {}
    for ks in at.values():
        for x in range(len(ks)):
            for y in range(x):
                shared[ks[y], ks[x]] = shared.get((ks[y], ks[x]), 0) + 1
    all_sets, firsts = list(sets), [min(ids) for ids in sets.values()]
    pairs = [(firsts[a], firsts[b]) for (a, b), n in shared.items() if 5 * n >= 4 * (len(all_sets[a]) + len(all_sets[b]) - n)]
    assert pairs and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.98
    root = {i: i for i in firsts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(find(a) == find(b) for a in firsts for b in [got[a]] if b != a)  # no link that pairs at 0.8 don't make


def test_rows_that_share_an_identifier(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, long), (5, replaced(long, [50])), (5, "a b c d e f g h"), (4, "x y z"), (4, "x y z"), (7, long), (9, "A b c d e f g h"), (9, "q r s"), (None, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.drop_similar(docs).collect()), key=str)
    first = min(long, replaced(long, [50]))
    assert kept == sorted([(5, first), (5, "a b c d e f g h"), (4, "x y z"), (9, "q r s"), (None, "q r s")], key=str)


def test_band_links_in_blocks_like_one_group(spark):
    """Groups of near copies and of strangers that share a band, dealt into blocks or not: the same components."""
    import random

    rnd = random.Random(6)
    sets = []
    for _ in range(12):
        base = [rnd.getrandbits(64) for _ in range(120)]
        for _ in range(6):
            sets.append(np.array(sorted({*base[rnd.randrange(12) :], rnd.getrandbits(64)}), np.uint64))
    rows = []
    for i, hashes in enumerate(sets):
        own, sketch = simhash.bands(hashes)
        rows.append((i, [int(np.uint64(b).astype(np.int64)) for b in own[:6]] + [7], bytearray(sketch)))
    nodes = spark.createDataFrame(rows, "node bigint, bands array<bigint>, sketch binary")
    roots = []
    for block in (1_000, 10):
        found = {r.node: r.root for r in components(simhash.band_links(nodes, block)).collect()}
        roots.append([found.get(i, i) for i in range(len(sets))])
    assert roots[0] == roots[1] == [i // 6 * 6 for i in range(len(sets))], "the band that all share brings no strangers together"


def test_drop_similar_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 5, "g", 6), (1, text, 5, "g", 6), (2, text + " end", 5, "g", 6), (3, "other words", 5, "g", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __node int, __gone string, __nth int")
    out = simhash.drop_similar(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r["__gone"]) for r in out.collect()) == [(1, "g"), (3, "g")]
