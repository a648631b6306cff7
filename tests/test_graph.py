import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from siltstone.operators import analytics, chunking, graph
from siltstone.plans import catalog

NODE = "id string, label string, kind string, subkind string, file string, start_line int, end_line int, lang_key string"
EDGE = "source string, target string, relation string, confidence string, module string, base_kind string, from_file string, from_line int"


def node(i, label, kind, file, a=1, b=1):
    return (i, label, kind, kind, file, a, b, "python")


def edge(s, t, relation, confidence="resolved", module=None):
    return (s, t, relation, confidence, module, None, "/x/main.py", 1)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [node("fmain", "main.py", "file", "/x/main.py"), node("futil", "util.py", "file", "/x/util.py"), node("go", "go", "function", "/x/main.py", 1, 3), node("srv", "Service.run", "function", "/x/main.py", 5, 8), node("helper", "helper", "function", "/x/util.py", 1, 2), node("other", "other", "function", "/x/util.py", 4, 5), node("svccls", "Service", "class", "/x/main.py", 4, 10), node("ext_util", "util", "external", "")]
    edges = [edge("fmain", "go", "contains"), edge("fmain", "srv", "contains"), edge("svccls", "srv", "contains"), edge("futil", "helper", "contains"), edge("futil", "other", "contains"), edge("fmain", "ext_util", "imports_from", module="util"), edge("go", "srv", "calls"), edge("srv", "helper", "calls"), edge("srv", "other", "calls")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_queries(spark, small):
    nodes, edges = small
    ask = lambda s: graph.asked(spark, s)
    assert [r.node_id for r in graph.find_symbols(nodes, ask("HELPER")).collect()] == ["helper"]
    assert sorted(r.node_id for r in graph.find_symbols(nodes, ask("serv")).collect()) == ["srv", "svccls"]
    assert graph.find_symbols(nodes, ask("  ")).count() == 0
    assert [r.from_symbol for r in graph.callers(nodes, edges, ask("helper")).collect()] == ["Service.run"]
    assert graph.callers(nodes, edges, ask("go")).count() == 0
    assert {r.to_symbol for r in graph.callees(nodes, edges, ask("Service.run")).collect()} == {"helper", "other"}
    for by in ("main.py", "go"):
        assert [r.module for r in graph.imports(nodes, edges, ask(by)).collect()] == ["util"]
    pairs = spark.createDataFrame([("go", "helper"), ("other", "go")], "source_symbol string, target_symbol string")
    assert [(r.hops, r.path) for r in graph.shortest_path(nodes, edges, pairs).collect()] == [(2, "go>srv>helper")]
    assert {r.label for r in graph.nodes_in_file(nodes, spark.createDataFrame([("UTIL.py",)], "asked string")).collect()} == {"helper", "other"}
    near = {(r.from_symbol, r.to_symbol) for r in graph.neighbors(nodes, edges, ask("helper"), 1).collect()}
    assert near == {("util.py", "helper"), ("Service.run", "helper")}
    view = {r.id: r.layer for r in graph.symbol_view(nodes, edges, ask("Service.run")).collect()}
    assert view == {"srv": 0, "go": -1, "helper": 1, "other": 1}
    summary = graph.module_summary(nodes, edges, spark.createDataFrame([("util.py",)], "asked string")).first()
    assert (summary.n_symbols, summary.dependents) == (2, "/x/main.py")


def test_transitive_callers_on_a_cycle(spark):
    nodes = spark.createDataFrame([node(x, x.upper(), "function", "/c.py") for x in "abct"], NODE)
    edges = spark.createDataFrame([edge("a", "b", "calls"), edge("b", "c", "calls"), edge("c", "t", "calls"), edge("t", "t", "calls")], EDGE)
    got = lambda d: {r.label: r.depth for r in graph.transitive_callers(nodes, edges, graph.asked(spark, "T"), d).collect()}
    assert got(3) == {"C": 1, "B": 2, "A": 3} and got(1) == {"C": 1} and got(0) == {"C": 1}


def test_two_cliques(spark):
    names = [f"{g}{i}" for g in "ab" for i in range(1, 5)]
    nodes = spark.createDataFrame([node(n, n, "function", "/x.py") for n in names] + [node("fileA", "a.py", "file", "/a.py"), node("extstd", "std", "external", "")], NODE)
    rows = [edge(f"{g}{i}", f"{g}{j}", "calls") for g in "ab" for i in range(1, 5) for j in range(1, 5) if i != j]
    rows += [edge("a1", "b1", "calls"), edge("fileA", "extstd", "imports")] + [edge("fileA", f"a{i}", "contains") for i in range(1, 5)]
    edges = spark.createDataFrame(rows, EDGE)
    assert analytics.hubs(nodes, edges).orderBy("rank").first().id == "a1"
    found = analytics.communities(nodes, edges).collect()
    assert {r.languages for r in found} == {"python:4"}
    assert sorted(r["size"] for r in found) == [4, 4] and all("file" not in r.members and "ext" not in r.members for r in found)
    top = analytics.bridges(nodes, edges).orderBy("rank").first()
    assert (top.a, top.b) == ("a1", "b1") and top.score == round(16 / 28, 6)
    none = nodes.limit(0), edges.limit(0)
    assert analytics.hubs(*none).count() == analytics.communities(*none).count() == analytics.bridges(*none).count() == 0


def test_bridges_by_joins_equal_those_in_tasks(spark, monkeypatch):
    rnd = random.Random(8)
    pairs = {tuple(sorted((f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}"))) for _ in range(14)} | {("n3", "x1"), ("x1", "x2"), ("y1", "y2")}
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, "function") for i in ids], "id string, kind string")
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "source string, target string")
    got = lambda: [tuple(r) for r in analytics.bridges(nodes, edges, 50).orderBy("rank").collect()]
    want = got()
    monkeypatch.setattr(analytics, "LOCAL_EDGES", 0)
    assert got() == want and len(want) > 5
    assert analytics.bridges(nodes.limit(0), edges.limit(0)).count() == 0
    monkeypatch.setattr(analytics, "EXACT_NODES", 2)
    monkeypatch.setattr(analytics, "SAMPLE", 4)
    few = got()
    monkeypatch.setattr(analytics, "LOCAL_EDGES", 100)
    assert got() == few, "the same sources stand for all"


def build(spark, files):
    facts = chunking.extract_facts(spark.createDataFrame(list(files.items()), "path string, content string"))
    node_rows, edge_rows, calls, bases = chunking.graph_inputs(facts)
    nodes = graph.upsert_nodes(node_rows)
    edges, stubs = graph.upsert_edges(edge_rows, nodes)
    return nodes.unionByName(stubs.select(*nodes.columns)), edges, calls, bases


def rows_of(edges):
    return sorted((r.source, r.target, r.relation, r.confidence or "", r.base_kind or "") for r in edges.collect())


STEPS = [
    {"/p/util.py": "def helper(x): return x + 1", "/p/service.py": "from util import helper\nclass Base: pass\nclass Service(Base):\n    def run(self):\n        return helper(1)"},
    {"/p/main.py": "from service import Service\ndef main():\n    Service().run()\n    extra()"},
    {"/p/extra.py": "def extra(): pass\nclass Child(Service): pass"},
    {"/p/extra2.py": "def extra(): pass"},
    {"/p/util.py": None},
    {"/p/extra.py": None},
]


def test_reresolution_equals_a_full_build(spark):
    files: dict[str, str] = {}
    last = None
    for step in STEPS:
        before = dict(files)
        files.update({k: v for k, v in step.items() if v is not None})
        for k, v in step.items():
            if v is None:
                files.pop(k)
        nodes, edges, calls, bases = build(spark, files)
        full = graph.resolve_all(nodes, edges, calls, bases)
        if last is not None:
            changed = {**{k: before.get(k, "") for k in step}, **{k + "+": v or "" for k, v in step.items()}}
            facts = chunking.extract_facts(spark.createDataFrame([(k.rstrip("+"), v) for k, v in changed.items()], "path string, content string"))
            names = facts.where("fact = 'node' and kind in ('function', 'class')").selectExpr("element_at(split(label, '[.]'), -1) as leaf")
            own = facts.where("fact = 'raw_call'").selectExpr("b as leaf").unionByName(facts.where("fact = 'raw_inherit'").selectExpr("b as leaf"))
            alive = nodes.select("id")
            stale = last.where("confidence in ('resolved', 'ambiguous') and relation in ('calls', 'inherits')").join(alive.withColumnRenamed("id", "source"), "source", "left_semi").join(alive.withColumnRenamed("id", "target"), "target", "left_semi")
            mixed = edges.unionByName(stale.select(*edges.columns))
            again = graph.reresolve(nodes, mixed, calls, bases, names.unionByName(own))
            assert rows_of(again) == rows_of(full)
        last = spark.createDataFrame(full.collect(), full.schema)
    assert ("p_main_main", "p_extra2_extra", "calls", "resolved", "") in rows_of(last)


def test_ambiguity(spark):
    files = {"/a.py": "def foo(): pass", "/b.py": "def foo(): pass", "/caller.py": "def go():\n    foo()\n    x.foo()"}
    nodes, edges, calls, bases = build(spark, files)
    got = [e for e in rows_of(graph.resolve_all(nodes, edges, calls, bases)) if e[2] == "calls"]
    assert [e[3] for e in got] == ["ambiguous", "ambiguous"]
    files.pop("/b.py")
    got = [e for e in rows_of(graph.resolve_all(*build(spark, files))) if e[2] == "calls"]
    assert [e[3] for e in got] == ["resolved"]


def test_views_and_texts(spark, small):
    from siltstone.plans import render

    nodes, edges = small
    view = [r.asDict() for r in graph.symbol_view(nodes, edges, graph.asked(spark, "Service.run")).collect()]
    svg = render.view_svg(view, [("go", "srv"), ("srv", "helper"), ("srv", "missing")])
    assert svg.count("<rect") == 4 and svg.count("<line") == 2 and svg == render.view_svg(view[::-1], [("srv", "helper"), ("go", "srv")])
    assert "&lt;b&gt;" in render.view_html("<b>", view, [])
    assert render.edges_text(graph.callers(nodes, edges, graph.asked(spark, "helper")).collect()) == "Service.run --calls--> helper  /x/main.py:1"
    assert render.hits_text([]) == "Nothing found." and render.cut("x" * 40).endswith("…")


def test_communities_of_a_large_component(spark):
    """Two cliques of 150 joined by one edge: over 20,000 edges in one component."""
    names = [f"{g}{i:03}" for g in "ab" for i in range(150)]
    nodes = spark.createDataFrame([node(n, n, "function", "/x.py") for n in names], NODE)
    rows = [edge(x, y, "calls") for x in names for y in names if x < y and x[0] == y[0]] + [edge("a000", "b000", "calls")]
    found = analytics.communities(nodes, spark.createDataFrame(rows, EDGE)).collect()
    assert len(rows) > 20_000 and sorted((r.community, r["size"]) for r in found) == [("a000", 150), ("b000", 150)]


def test_communities_of_a_component_beyond_a_task(spark, monkeypatch):
    """Merges by joins find the cliques of a ring; of a random graph, links and degrees stay those between the groups and modularity is near that of merges one by one."""
    rnd = random.Random(5)
    ring = [(f"c{k}_{j}", f"c{k}_{i}") for k in range(6) for i in range(6) for j in range(i)] + [(f"c{k}_0", f"c{(k + 1) % 6}_0") for k in range(6)]
    names = sorted({x for p in ring for x in p})
    nodes = spark.createDataFrame([node(n, n, "function", "/x.py") for n in names], NODE)
    monkeypatch.setattr(analytics, "LOCAL_PAIRS", 40)
    found = analytics.communities(nodes, spark.createDataFrame([edge(x, y, "calls") for x, y in ring], EDGE)).collect()
    assert {(r.community, r["size"], r.members) for r in found} == {(f"c{k}_0", 6, ",".join(f"c{k}_{i}" for i in range(6))) for k in range(6)}

    wild = sorted({tuple(sorted(rnd.sample([f"r{i:03}" for i in range(80)], 2))) for _ in range(200)})
    monkeypatch.setattr(analytics, "LOCAL_PAIRS", 60)
    links = spark.createDataFrame([("w", len(wild), *p, *(sum(x in q for q in wild) for x in p), 1) for p in wild], "component string, m long, a string, b string, da long, db long, w long")
    left, members = analytics._agglomerated(links)
    at = {x: x for p in wild for x in p} | {r.id: r.group for r in members.collect()}
    rows = left.collect()
    assert len(rows) <= 60
    for r in rows:
        assert r.w == sum({at[a], at[b]} == {r.a, r.b} for a, b in wild) and (r.da, r.db) == tuple(sum((at[a] == x) + (at[b] == x) for a, b in wild) for x in (r.a, r.b))

    def modularity(groups):
        degree = {}
        for x in (x for p in wild for x in p):
            degree[groups[x]] = degree.get(groups[x], 0) + 1
        return sum(groups[a] == groups[b] for a, b in wild) / len(wild) - sum(d * d for d in degree.values()) / (2 * len(wild)) ** 2

    then = analytics.modularity_groups([(r.a, r.b) for r in rows], [r.w for r in rows], {r.a: r.da for r in rows} | {r.b: r.db for r in rows}, len(wild))
    assert modularity({x: then.get(g, g) for x, g in at.items()}) > 0.8 * modularity(analytics.modularity_groups(wild)) > 0.2


def test_pairs_of_references_are_not_exchanged(spark):
    index = spark.createDataFrame([("f", f"n{i}") for i in range(2_500)] + [("g", "lone")], "leaf string, node_id string")
    raw = spark.createDataFrame([("n0", "F", "b", 2), ("n0", "f", "a", 1), (None, "g", "c", 3), ("x", "none", "c", 3)], "origin string, name string, file string, line int")
    existing = spark.createDataFrame([("n0", "n1"), ("n0", "lone")], "source string, target string")
    found = graph.resolve(raw, index, existing, "calls", "name", "origin")
    assert "keys=[source" not in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    rows = {(r.source, r.target, r.confidence, r.from_file, r.from_line) for r in found.collect()}
    assert rows == {("n0", f"n{i}", "ambiguous", "a", 1) for i in range(2, 2_500)}
    loops = graph.resolve(raw, index, existing, "calls", "name", "origin", self_loops=True).where("source IS NULL").collect()
    assert [(r.target, r.confidence, r.from_file) for r in loops] == [("lone", "resolved", "c")]
    twice = index.unionByName(spark.createDataFrame([("g", "n7")], "leaf string, node_id string"))
    again = [r.target for r in graph.resolve(raw.where("origin IS NOT NULL").unionByName(spark.createDataFrame([("n0", "g", "z", 9)], raw.schema)), twice, existing, "calls", "name", "origin").collect()]
    assert len(again) == len(set(again)) == 2_498


def test_inheritance_of_what_is_called_is_left_out(spark):
    nodes = spark.createDataFrame([("a", "m.A", "class"), ("b", "m.B", "class")], "id string, label string, kind string").selectExpr("*", "'' AS subkind", "'' AS file", "0 AS start_line", "0 AS end_line", "'' AS lang_key")
    none = spark.createDataFrame([], "source string, target string, relation string, confidence string, module string, base_kind string, from_file string, from_line int")
    calls = spark.createDataFrame([("a", "B", False, "f", 1), ("a", "A", False, "f", 2)], "caller string, callee_name string, is_member boolean, file string, line int")
    bases = spark.createDataFrame([("a", "b", "extends", "f", 3), ("a", "A", "extends", "f", 4), ("b", "A", "extends", "f", 5)], "child string, base_name string, base_kind string, file string, line int")
    rows = sorted((r.source, r.target, r.relation, r.from_line) for r in graph.resolve_all(nodes, none, calls, bases).collect())
    assert rows == [("a", "a", "inherits", 4), ("a", "b", "calls", 1), ("b", "a", "inherits", 5)]


def _two_alike(spark):
    row = lambda i, label, line: (i, label, "function", "", "/f.py", line, line, "python")
    nodes = spark.createDataFrame([row("a", "m.f", 1), row("b", "m.f", 1), row("c", "m.g", 5), row("d", "m.h", 7)], "id string, label string, kind string, subkind string, file string, start_line int, end_line int, lang_key string")
    edges = spark.createDataFrame([(s, "c", "calls", "extracted", "", "", "/f.py", 2) for s in ("a", "b", "d")], ", ".join(f"{c} {'int' if c == 'from_line' else 'string'}" for c in graph.EDGE))
    return nodes, edges


def test_callers_that_look_the_same_are_one_row(spark):
    nodes, edges = _two_alike(spark)
    asked = graph.asked(spark, "g")
    assert sorted(r.from_symbol for r in graph.callers(nodes, edges, asked, None).collect()) == ["m.f", "m.h"]
    assert sorted(r.from_symbol for r in graph.callers(nodes, edges, asked, 2).collect()) == ["m.f", "m.h"]


@pytest.mark.parametrize("bound", [10_000, 0])
def test_nodes_are_not_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "ASKED_SYMBOLS", bound)
    nodes, edges = _two_alike(spark)
    found = graph.find_symbols(nodes, graph.asked(spark, "G", "m.f", ".", " "))
    assert sorted(map(tuple, found.collect())) == [(".", x) for x in "abcd"] + [("G", "c"), ("m.f", "a"), ("m.f", "b")]
    plan = graph.flat_edges(edges, nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_walks_by_levels_credit_edges():
    """The path 0 - 1 - 2 and the square 3 - 4 - 5 - 6, as numbers."""
    begin, ends = np.array([0, 1, 3, 4, 6, 8, 10, 12]), np.array([1, 0, 2, 1, 4, 6, 3, 5, 4, 6, 3, 5], np.int32)
    sources = pa.RecordBatch.from_pydict({"n": list(range(7))})
    total = {}
    for batch in analytics._brandes(iter([sources]), begin, ends):
        for r in batch.to_pylist():
            total[r["a"], r["b"]] = total.get((r["a"], r["b"]), 0.0) + r["c"]
    assert total == {(0, 1): 4.0, (1, 2): 4.0, (3, 4): 4.0, (4, 5): 4.0, (5, 6): 4.0, (3, 6): 4.0}


def test_large_components_merge_in_blocks_and_nothing_goes_through_the_driver(spark, monkeypatch):
    """Groups halve in a round, few rounds are left, and joins of nodes and pairs are no broadcasts however small Spark takes them to be."""
    names = [f"{g}{i:02}" for g in "abcd" for i in range(24)]
    pairs = [(x, y) for x in names for y in names if x < y and x[0] == y[0]] + [("a00", "b00"), ("b00", "c00"), ("c00", "d00")]
    nodes = spark.createDataFrame([node(n, n, "function", "/x.py") for n in names], NODE)
    edges = spark.createDataFrame([edge(x, y, "calls") for x, y in pairs], EDGE)
    monkeypatch.setattr(analytics, "LOCAL_PAIRS", 20)
    turns = []
    merges = analytics._merges
    monkeypatch.setattr(analytics, "_merges", lambda links, turn: turns.append(turn) or merges(links, turn))
    found = analytics.communities(nodes, edges)
    assert sorted((r.community, r["size"]) for r in found.collect()) == [(f"{g}00", 24) for g in "abcd"] and len(turns) < 30
    made = catalog.inputs(spark, "/root/testdata/sf0.001", catalog.EDGES, catalog._CALLS)
    for df in (analytics.symbol_pairs(nodes, edges), found, *made):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    rows = [("w", 3, "x", "y", 2, 2, 1), ("w", 3, "x", "z", 2, 2, 1), ("w", 3, "y", "z", 2, 2, 1)]
    halved = analytics._halved(pd.DataFrame(rows, columns=["component", "m", "a", "b", "da", "db", "w"]))
    assert sorted(map(tuple, halved.values.tolist())) == [("x", "x", 6), ("y", "x", 6), ("z", "x", 6)]


@pytest.mark.parametrize("twice", [False, True])
def test_counts_after_a_new_resolution_make_no_pairs(spark, monkeypatch, twice):
    """Self calls, taken pairs, member calls, unknown origins, stale and repeated nodes: the counts are those of the edges."""
    row = lambda i, label, kind="function": (i, label, kind, kind, "/f.py", 1, 2, "python")
    nodes = spark.createDataFrame([row("a", "m.F", "class"), row("b", "n.f"), row("c", "n.g"), row("d", "n.h"), row("e", "n.h"), row("x", "x.f", "file")] + [row("c", "n.f")] * twice, NODE)
    edges = spark.createDataFrame([edge("a", "b", "calls", "extracted"), edge("d", "c", "calls", "resolved"), edge("c", "d", "calls", "ambiguous"), edge("a", "zz", "contains", None)], EDGE)
    calls = spark.createDataFrame([("a", "F", False, "f", 1), ("b", "f", True, "f", 2), ("b", "G", True, "f", 3), ("c", "h", False, "f", 4), ("d", "h", False, "f", 5), (None, "f", False, "f", 6), ("d", "g", False, "f", 7), ("c", "none", False, "f", 8)], "caller string, callee_name string, is_member boolean, file string, line int")
    bases = spark.createDataFrame([("a", "f", "extends", "f", 1), ("a", "F", "extends", "f", 2), ("d", "h", "extends", "f", 3), (None, "f", "extends", "f", 4), ("e", "f", "extends", "f", 5)], "child string, base_name string, base_kind string, file string, line int")
    for asked in (["F", "g"], ["h"], ["none"], ["f", "g", "h"]):
        names = spark.createDataFrame([(x,) for x in asked], "leaf string")
        again = graph.reresolve(nodes, graph.resolve_all(nodes, edges, calls, bases), calls, bases, names)
        expected = {(r.relation, r.confidence): r["count"] for r in again.groupBy("relation", "confidence").count().collect()}
        with monkeypatch.context() as m:
            if not twice:
                m.setattr(graph, "resolve", None)
            assert {(r.relation, r.confidence): r.n for r in graph.reresolved_counts(nodes, edges, calls, bases, names).collect()} == expected


def test_bridges_by_blocks_equal_those_in_tasks(spark, monkeypatch):
    """Credits as blocks of numbers, edges expanded a few at a time, and joins give the rows of the walks in tasks."""
    rnd = random.Random(9)
    nodes = spark.createDataFrame([node(f"n{i:02}", f"n{i:02}", "function", "/x.py") for i in range(60)], NODE)
    edges = spark.createDataFrame([edge(*(f"n{i:02}" for i in p), "calls") for p in sorted({tuple(rnd.sample(range(60), 2)) for _ in range(110)})], EDGE)
    got = lambda n: [tuple(r) for r in analytics.bridges(nodes, edges, n).orderBy("rank").collect()]
    whole = {n: got(n) for n in (3, 500)}
    monkeypatch.setattr(analytics, "LOCAL_EDGES", 0)
    monkeypatch.setattr(analytics, "STEP", 7)
    monkeypatch.setattr(analytics, "CREDITS", 20)
    called = []
    joined = analytics._joined_credit
    monkeypatch.setattr(analytics, "_joined_credit", lambda *args: called.append(1) or joined(*args))
    assert {n: got(n) for n in (3, 500)} == whole and not called
    monkeypatch.setattr(analytics, "BLOCK_EDGES", 0)
    assert got(3) == whole[3] and called
