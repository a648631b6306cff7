import math

from siltstone.llm.mixing import mix_sources, source_targets

DOCS = "doc_id bigint, text string, source string, size int"


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares again and again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_like_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "é": 70, None: 400}, {"a": 0, "b": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 100_000, "d": 3, "e": 9}):
        rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n_rows bigint")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = brute_targets(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_mix_meets_targets_and_repeats(spark, monkeypatch):
    import siltstone.llm.mixing as m

    monkeypatch.setattr(m, "SLICE_ROWS", 7)
    rows = [(i, " ".join(["w"] * (i % 13)), "abc"[i % 3] if i % 7 else "a", 0) for i in range(300)]
    rows += [(900, None, "b", 0), (901, "x y", None, 0), (None, "x\ty\x0b", "a", 0), (5, "again again", "c", 0), (5, "again again", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(map(tuple, mix_sources(docs).collect()), key=str)
    assert one == sorted(map(tuple, mix_sources(docs.repartition(9)).collect()), key=str)
    assert len(one) == len(rows)
    taken, source = {}, {}
    out = mix_sources(docs, keep_row=True).collect()
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        source[r.source] = r.target
    assert all(abs(taken[s] - source[s]) <= 0.5 for s in source)
    for s in source:
        whole = {r.taken // r["size"] for r in out if r.source == s and r["size"]}
        assert max(whole) - min(whole) <= 1, "whole epochs come before fractions"
    assert mix_sources(docs.limit(0)).count() == 0
