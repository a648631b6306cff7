import math

import numpy as np
import pytest

from siltstone.llm import pivot_index as m

KIND = "vec_id bigint, embedding array<float>, vector string, id int, ring string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], KIND)


def plain(rows, k=10, every=100):
    """Every query against every row."""
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in fine:
        if i % every == 0:
            asks[i] = max(asks.get(i, v), v)
    out = []
    for q, v in asks.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def found(spark, rows, k=10):
    all_of = frame(spark, rows).repartition(5)
    return sorted(map(tuple, m.search(all_of, all_of.where("vec_id % 100 = 0"), k).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(m, "BLOCK_VALUES", 128)
    monkeypatch.setattr(m, "ROUNDS", (2, 5, m.MAX_PIVOTS * m.MAX_RINGS))
    monkeypatch.setattr(m, "TILE", 4)


def test_like_every_pair(spark, small_blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    assert found(spark, rows) == plain(rows)


def test_hot_vector_ties_and_repeats(spark, small_blocks):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, -0.25, 0.125, 1.0]) for i in range(300)] + [(300 + i, rng.normal(size=4).tolist()) for i in range(400)]
    rows += [(100, [9.0, 9.0, 9.0, 9.0]), (100, [1.0, 2.0, 3.0, 4.0]), (305, [7.0, 7.0, 7.0, 7.0]), (305, [7.0, 7.0, 7.0, 7.0])]
    assert found(spark, rows) == plain(rows)
    index = m.build_index(m.integer_vectors(frame(spark, rows)))
    held = index.blocks.selectExpr("size(ids) AS n").collect()
    assert sum(r.n for r in held) == len(rows), "every row is in the index"
    assert max(r.n for r in held) < 90, "a vector that fills the table is many blocks"


def test_nulls_lengths_and_large_numbers(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [3.0]), (2, [1.0, 2.0, 3.0]), (500, [2.0, 0.0, 1.0, 4.0]), (600, []), (3, [-1.0, 0.5])]
    assert found(spark, rows) == plain(rows)
    big = [(i, [(-1) ** i * 1e3 * i, 5e4 + i, 0.001]) for i in range(200)]
    assert found(spark, big) == plain(big)
    assert found(spark, []) == [] and found(spark, rows[1:5]) == [] and found(spark, [(0, [1.0])]) == []


def test_bounds_hold_and_close_annuli(spark, small_blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 20
    rows = [(i, (centres[i % 12] + rng.normal(size=6)).tolist()) for i in range(900)]
    index = m.build_index(m.integer_vectors(frame(spark, rows)))
    queries = np.array([[math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i % 100 == 0])
    upper = index.upper(queries)
    read = 0
    for r in index.blocks.collect():
        scores = m.products(queries, np.array(r.vectors).reshape(-1, index.width))
        assert (scores.max(axis=1) <= upper[:, r.ring]).all()
    least = {q: min(s for x, _, _, s in plain(rows) if x == q) for q, *_ in plain(rows)}
    read = sum((upper[n] >= least[q]).sum() for n, q in enumerate(sorted(least)))
    assert read < 0.5 * upper.size, "clustered vectors leave most annuli unread"
    assert found(spark, rows) == plain(rows)


def test_pairs_are_not_broadcast(spark):
    pairs = spark.range(3).selectExpr("int(id) AS ring", "0 AS slice", "array(id) AS query_ids", "array(1) AS queries", "array(0D) AS floor")
    blocks = spark.range(3).selectExpr("int(id) AS ring", "0 AS slice", "array(id) AS ids", "array(1) AS vectors")
    plan = m._met(pairs, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
