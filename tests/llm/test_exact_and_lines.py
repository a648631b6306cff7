import hashlib
import random

from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.line_dedup import line_dedup

DOCS = "doc_id bigint, text string, source string"


def test_exact_dedup_nulls_ties_and_repeats(spark):
    rows = [(1, "a", None), (2, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "", "x"), (None, "a", "x"), (5, "b " * 50_000, "x"), (6, "A", "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for keep, best in (("largest", {"a": 2, "": 4}), ("smallest", {"a": 1, "": 3})):
        out = exact_dedup(docs, keep=keep).collect()
        assert len(out) == len(rows)
        by = {}
        for r in out:
            by.setdefault(r.text_sha256, []).append(r)
        for text, keep_id in best.items():
            group = by[hashlib.sha256(text.encode()).hexdigest()]
            assert {r.keep_id for r in group} == {keep_id}
            assert {r.group_size for r in group} == {len(group)} and sum(r.kept for r in group) == 1
            assert next(r for r in group if r.kept).doc_id == keep_id
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_merges_many_runs(spark):
    random.seed(1)
    rows = [(i, random.choice("abcdefgh"), "s") for i in range(400)]
    out = exact_dedup(spark.createDataFrame(rows, DOCS).repartition(23), fan_in=2).collect()
    least = {}
    for i, t, _ in rows:
        least[t] = min(least.get(t, i), i)
    text = {i: t for i, t, _ in rows}
    assert all(r.keep_id == least[text[r.doc_id]] and r.kept == (r.doc_id == r.keep_id) for r in out)


def test_line_dedup(spark):
    rows = [(i, f"Menu\nown {i}\n\nend {i}" if i < 8 else f"own {i}\n" + "\n" * (i == 9), "a") for i in range(20)]
    rows += [(100, "Menu\nx", "b"), (101, None, "a"), (102, "", None), (103, "Menu", "a"), (104, "Menu\nMenu\nown 0", "a")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], DOCS + ", n_lines string")
    out = {r.doc_id: r for r in line_dedup(docs, ratio=0.2, min_pages=10).collect()}
    assert out[0].text == "own 0\n\nend 0" and out[0].n_dropped == 1 and out[0].n_lines == 4
    assert out[100].text == "Menu\nx", "a host with too few pages keeps its lines"
    assert out[101].text is None and out[101].n_lines == 0
    assert out[102].text == "" and out[103].text == "" and out[104].text == "own 0"
    assert len(out) == len(rows)
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_salted_equals_broadcast(spark, monkeypatch):
    import siltstone.llm.line_dedup as m

    docs = spark.createDataFrame([(i, f"all\nown {i}", "ab"[i % 2]) for i in range(60)], DOCS)
    one = sorted(map(tuple, line_dedup(docs).collect()))
    monkeypatch.setattr(m, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, line_dedup(docs).collect())) == one


def test_line_dedup_with_clashing_columns_and_a_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(200_000))
    rows = [(i, f"Menu\nown {i}" if i else f"Menu\n{long}", "a", [f"k{i}"], "r", 7, "h", 3) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS + ", __kept_lines array<string>, __rule_lines string, __rule_salt int, __rule_host string, __doc_salt int")
    out = line_dedup(docs, ratio=0.2, min_pages=10)
    assert out.columns == docs.columns + ["n_lines", "n_dropped"]
    for r in out.collect():
        assert r.text == (f"own {r.doc_id}" if r.doc_id else long) and r.n_dropped == 1
        assert (r["__kept_lines"], r["__rule_lines"], r["__rule_salt"], r["__rule_host"], r["__doc_salt"]) == ([f"k{r.doc_id}"], "r", 7, "h", 3)
