from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, upkeep
from siltstone.plans.engine import Engine
from siltstone.sources import files, pdf, web
from siltstone.streaming import live

DEMO = '"""Doc."""\nimport os\n\n\ndef greet(name):\n    return name\n\n\nclass Greeter:\n    def __init__(self):\n        pass\n\n    @property\n    def hello(self):\n        return greet("x")\n'
SHARP = "using System;\nnamespace MyFramework.Damage {\n  public interface IDamageable { void ApplyDamage(int x); }\n  public class HealthSystem : IDamageable {\n    public void ApplyDamage(int x) { Heal(-x); }\n    public void Heal(int x) { /* { */ }\n  }\n}\n"


def test_chunks_of_python_and_braces():
    got = chunking.chunks_of("/demo.py", DEMO, "python")
    assert [g[0] for g in got] == ["<header>", "greet", "Greeter.__init__", "Greeter.hello"]
    assert got[3][4:] == (13, 15) and got[3][2].startswith("    @property")
    names = [g[0] for g in chunking.chunks_of("/h.cs", SHARP, "c_sharp")]
    assert any(n.endswith("HealthSystem.ApplyDamage") for n in names) and any(n.endswith("HealthSystem.Heal") for n in names)


def test_windows_and_long_chunks():
    text = " ".join(f"w{i}" for i in range(2_500))
    got = chunking.chunks_of("/x.txt", text, None)
    assert [g[0] for g in got] == ["<chunk0>", "<chunk1>", "<chunk2>"] and got[1][2].startswith("w924 ")
    body = "def f():\n" + "    x = 1\n" * 2_000
    assert [g[0] for g in chunking.chunks_of("/f.py", body, "python")][:2] == ["f#part0", "f#part1"]
    assert chunking.chunks_of("/broken.py", "def (", "python")[0][1] == "text_window" and chunking.chunks_of("/e.py", "", "python") == []


def test_facts():
    facts = chunking.facts_of("/p/demo.py", DEMO + "\ndef out():\n    external_func()\n    obj.method()\n    out()\n", "python")
    assert ("edge", "p_demo_greeter_hello", "p_demo_greet") in {f[:3] for f in facts if f[10] == "calls"}
    raw = {(f[2], f[11]) for f in facts if f[0] == "raw_call"}
    assert raw == {("external_func", False), ("method", True)}
    assert any(f[10] == "imports" and f[3] == "os" for f in facts) and not any(f[0] == "edge" and f[1] == f[2] for f in facts)


def test_files(spark, tmp_path):
    for p in ("pkg/app.py", "pkg/util.py", "node_modules/dep/vendor.py", "build/out.py", ".hidden/secret.py", "README.md", ".dotfile.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(DEMO)
    found = files.read_files(spark, str(tmp_path), ["py"], ["node_modules/", "/build/"])
    assert {r.file_name for r in found.collect()} == {"app.py", "util.py"}
    chunks = chunking.chunk_files(found.select("path", "content"))
    assert chunks.count() == 8 and {r.language for r in chunks.select("language").collect()} == {"python"}


def test_partition(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2x"), ("d", "4"), ("e", None)], "path string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", None)], "path string, sha256 string")
    assert {r.path: r.status for r in upkeep.partition_files(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added", "e": "changed"}


def test_crawl(spark):
    page = lambda *hrefs: "".join(f"<a class=x href='{h}'>l</a>" for h in hrefs)
    base = "https://docs.example.com"
    rows = [(f"{base}/", page("/guide/intro", "/about", "https://other.com/", "/legacy/old", "mailto:x@y.z")), (f"{base}/guide/intro", page("widgets", "../about#top", "/")), (f"{base}/guide/widgets", page("./intro")), (f"{base}/about/", page("/guide/widgets")), (f"{base}/legacy/old", page("/legacy/deep")), (f"{base}/legacy/deep", "")]
    pages = spark.createDataFrame([(u, h, 200, "text/html; charset=utf-8") for u, h in rows] + [(f"{base}/gone", "", 404, "text/html")], "url string, html string, status int, content_type string")
    got = lambda **k: {r.url.removeprefix(base): r.depth for r in web.crawl(pages, f"{base}/", **k).collect()}
    assert got(max_depth=1) == {"/": 0, "/guide/intro": 1, "/about": 1, "/legacy/old": 1}
    assert got(max_depth=3, excludes=("/legacy/",)) == {"/": 0, "/guide/intro": 1, "/about": 1, "/guide/widgets": 2}
    assert got(max_depth=3, includes=("/guide/",)) == {"/guide/intro": 1, "/guide/widgets": 2}
    assert len(got(max_pages=2)) == 2 and got(excludes=("example",)) == {}


def test_pdf_states(spark):
    rows = [("ok", False, 1.0, 2, 500, None), ("locked", True, 1.0, 2, 500, None), ("big", False, 101.0, 2, 500, None), ("many", False, 1.0, 6_000, 500, None), ("empty", False, 1.0, 2, 5, None), ("broken", False, 1.0, 2, 500, "x")]
    states = spark.createDataFrame(rows, "path string, encrypted boolean, size_mb double, total_pages int, n_chars int, error string").withColumn("status", pdf.status_of())
    assert {r.path: r.status for r in states.collect()} == {"ok": "ok", "locked": "skipped_password", "big": "skipped_too_large", "many": "skipped_too_many_pages", "empty": "skipped_empty", "broken": "error"}
    assert tuple(pdf.summary(states).first()) == (1, 4, 2)


def test_pdf_pages(spark):
    def pages(content):
        if content == b"bad":
            raise ValueError("broken xref")
        return [content.decode() * 60, "two " * 40]

    found = spark.createDataFrame([("/a.pdf", 0.1, bytearray(b"one ")), ("/b.pdf", 0.1, bytearray(b"bad"))], "path string, size_mb double, content binary")
    out = pdf.extract(found, pages)
    assert {r.path: r.status for r in out.collect()} == {"/a.pdf": "ok", "/b.pdf": "error"}
    stored = spark.createDataFrame([("/a.pdf", i, f"page_{i:04d}.md", "old") for i in (1, 2, 3)], "path string, page int, file string, text string")
    assert sorted((r.page, r.file) for r in pdf.refresh_pages(stored, out).collect()) == [(1, "page_0001.md"), (2, "page_0002.md")]


def test_debounce_batch_and_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    events = [("a", t0, "update"), ("a", t0 + timedelta(seconds=1), "delete"), ("a", t0 + timedelta(seconds=9), "update"), ("b", t0, "update")]
    table = spark.createDataFrame(events, "path string, at timestamp, action string")
    want = {("a", "delete", 2), ("a", "update", 1), ("b", "update", 1)}
    assert {(r.path, r.action, r.n_events) for r in live.debounce(table).collect()} == want
    moved = live.moves_as_pairs(spark.createDataFrame([("x", t0, "move", "y")], "path string, at timestamp, action string, dest string"))
    assert {(r.path, r.action) for r in moved.collect()} == {("x", "delete"), ("y", "update")}
    late = spark.createDataFrame([("z", t0 + timedelta(hours=1), "update")], "path string, at timestamp, action string")
    table.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.debounce(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.action, r.n_events) for r in spark.table("bursts").collect()} >= want


def test_apply_changes(spark):
    stored = spark.createDataFrame([("/a", "old a"), ("/b", "old b"), ("/c", "old c")], "file_path string, content string")
    t0 = datetime(2024, 1, 1)
    changes = spark.createDataFrame([("/a", t0, "update", "new a"), ("/b", t0, "update", "x"), ("/b", t0 + timedelta(seconds=1), "delete", None)], "path string, at timestamp, action string, content string")
    out = live.apply_changes(stored, changes, lambda f: f.withColumnRenamed("path", "file_path"))
    assert {tuple(r) for r in out.collect()} == {("/a", "new a"), ("/c", "old c")}


def test_drift_and_feedback(spark, tmp_path):
    row = lambda *r: spark.createDataFrame(list(r), "setting string, value string")
    got = {r.setting: r.severity for r in upkeep.drift(row(("path", "/a"), ("top_k", "5"), ("collection", "x")), row(("path", "/b"), ("top_k", "5"), ("mode", "m"))).collect()}
    assert got == {"path": "critical", "collection": "warning", "mode": "info"}
    (tmp_path / "f.jsonl").write_text('{"at": "2024-01-01", "tried": "x", "sources": ["a", "b"]}\nnot json\n[1]\n')
    records = files.read_feedback(spark, str(tmp_path / "f.jsonl"))
    assert {r.source: r.n for r in upkeep.feedback_summary(records).collect()} == {"a": 1, "b": 1}
    assert files.healthy(spark, str(tmp_path / "none")) == "corrupt"


def test_engine(spark):
    rows = [(f"c{i}", f"def {n}(): return compute_{n}(x)", f"/repo/{n}.py", n, "function", "python", 1, 2, "src") for i, n in enumerate(("alpha", "beta", "gamma", "delta"))]
    chunks = spark.createDataFrame(rows, "id string, content string, file_path string, symbol_name string, symbol_kind string, language string, start_line int, end_line int, source string")
    engine = Engine(spark, chunks)
    hits = engine.search("compute alpha", 1)
    assert engine.hit_rows(hits).first().symbol == "alpha" and engine.outline_rows(hits).columns[-2:] == ["signature", "doc"]
    assert engine.search_all(["beta"], 1).first().id == "c1"
    assert engine.deep_search(["nothing", "gamma delta"], min_score=0.1).where("id is not null").count() == 2
    assert engine.register_views("t") == ["t_chunks", "t_sources"] and spark.sql("select count(*) n from t_chunks").first().n == 4
    for bad in (lambda: engine.search(" "), lambda: engine.deep_search([]), lambda: engine.graph_query("callers", "x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        engine.deep_search("text")
    assert engine.deep_search_all(["nothing", "gamma delta"]).where("id is not null").count() == 2
    with pytest.raises(ValueError):
        engine.deep_search_all([" "])


def test_build_search_and_rebuild(spark, tmp_path, monkeypatch):
    from siltstone.__main__ import build, needs_update
    from siltstone.operators import postings
    from siltstone.sources import store

    root, index = tmp_path / "src", tmp_path / "index"
    root.mkdir()
    (root / "util.py").write_text("def helper(x):\n    return x + 1\n")
    (root / "main.py").write_text("from util import helper\n\ndef go():\n    return helper(2)\n")
    (root / "other.py").write_text("def third():\n    pass\n")
    build(spark, str(root), str(index), ["py"], [])
    tables = store.read_tables(spark, str(index))
    engine = Engine(spark, tables["chunks"], nodes=tables["nodes"], edges=tables["edges"])
    assert [r.from_symbol for r in engine.graph_query("callers", "helper").collect()] == ["go"]
    assert engine.find_definition("helper").first().found_by == "graph" and engine.find_definition("return x").first().found_by == "search_bm25"
    first = store.current(spark, str(index)).number
    assert build(spark, str(root), str(index), ["py"], []) == first, "nothing changed, nothing is written"
    assert not needs_update(spark, str(root), str(index), ["py"], [])
    (root / "main.py").write_text("def stop():\n    return helper(3)\n")
    assert needs_update(spark, str(root), str(index), ["py"], [])
    seen = []
    with monkeypatch.context() as m:
        for f in ("chunk_files", "extract_facts"):
            m.setattr(chunking, f, lambda df, f=getattr(chunking, f): seen.append({r.path.rsplit("/", 1)[-1] for r in df.select("path").collect()}) or f(df))
        build(spark, str(root), str(index), ["py"], [])
    assert seen == [{"main.py"}] * 2, "unchanged files are neither chunked nor parsed"
    tables = store.read_tables(spark, str(index))
    whole = tmp_path / "whole"
    build(spark, str(root), str(whole), ["py"], [])
    flat = lambda at: sorted(map(tuple, postings.PostingIndex(store.Log(spark, str(at))).flat().collect()))
    assert flat(index) == flat(whole) != []
    for name, df in store.read_tables(spark, str(whole)).items():
        if name in ("blocks", "retired", "sizes"):
            continue
        assert sorted(map(str, df.select(sorted(df.columns)).collect())) == sorted(map(str, tables[name].select(sorted(df.columns)).collect())), name
    stored, plain = Engine.open(spark, str(index)), Engine(spark, tables["chunks"])
    score = lambda e: [(r.id, r.score) for r in e.search("stop helper", 5).orderBy("rank").collect()]
    assert score(stored) == score(plain) != []
    both = Engine.open_all(spark, {"good": str(index), "bad": str(tmp_path / "none")})
    assert {(r.name, r.health) for r in both.source_rows().collect()} == {("good", "ok"), ("bad", "corrupt")} and both.search_all(["stop"], 1).count() == 1
    with pytest.raises(FileNotFoundError):
        Engine.open_all(spark, {"bad": str(tmp_path / "none")})
    assert {r.symbol_name for r in tables["chunks"].collect()} == {"helper", "stop", "third"}
    assert store.current(spark, str(tmp_path / "none")) is None


def test_imports_and_bases_by_language():
    """Hand-written edges: (source text, path, language) to the imports' (target, module, relation) and the bases' (name, kind)."""
    cases = [
        ("import os.path\nfrom ..pkg.mod import x\nfrom . import y\n", "/r/a.py", "python", [("os", "os.path", "imports"), ("pkg", "pkg.mod", "imports_from")], []),
        ("import com.x.Foo;\nimport com.y.Bar;\nclass A extends B implements C, D {\n}\n", "/r/A.java", "java", [("com_x_foo", "com.x.Foo", "imports"), ("com_y_bar", "com.y.Bar", "imports")], [("B", "extends"), ("C", "implements"), ("D", "implements")]),
        ("import u from './lib/u'\nimport x from 'react/jsx'\nclass A extends B {\n}\n", "/r/a.js", "javascript", [("r_a_js_lib_u", "./lib/u", "imports_from"), ("react", "react/jsx", "imports_from")], [("B", "extends")]),
        ("using System.Text;\nclass A : B, IC {\n}\n", "/r/A.cs", "c_sharp", [("system_text", "System.Text", "imports")], [("B", "extends_or_implements"), ("IC", "extends_or_implements")]),
        ('import (\n  "fmt"\n  "net/http"\n)\n', "/r/a.go", "go", [("fmt", "fmt", "imports"), ("net_http", "net/http", "imports")], []),
        ("use std::fs;\n", "/r/a.rs", "rust", [("std", "std::fs", "imports")], []),
    ]
    for source, path, language, imports, bases in cases:
        facts = chunking.facts_of(path, source, language)
        assert sorted((f[2], f[3], f[10]) for f in facts if f[0] == "edge" and f[10].startswith("imports")) == sorted(imports), (language, facts)
        assert sorted((f[2], f[4]) for f in facts if f[0] == "raw_inherit") == sorted(bases), language


def test_frameworks(spark):
    rows = [("file:/r/package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'), ("/r/requirements.txt", "Flask==2"), ("/r/manage.py", ""), ("/r/sub/package.json", '{"dependencies": {"vue": "1"}}'), ("/r/a/x.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web">'), ("/r/setup.py", None)]
    found = lambda rs: sorted(r.framework for r in files.frameworks(spark.createDataFrame(rs, "path string, content string"), "/r").collect())
    assert found(rows) == ["ASP.NET Core", "Django", "Flask", "React", "Vite"]
    assert found([("/r/package.json", "{broken")]) == found([]) == []
