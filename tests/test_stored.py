import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import postings, ranking
from siltstone.plans import sqlapi
from siltstone.plans.engine import Engine
from siltstone.sources import datasource
from siltstone.sources.store import Change, Conflict, Log
from siltstone.streaming import live

CHUNK = "id string, content string, file_path string"


def chunks_of(spark, texts):
    return spark.createDataFrame([(f"c{i}", t, f"/r/{i}.py") for i, t in texts.items()], CHUNK)


TEXTS = {i: f"common word{i % 7} word{i % 11} " + "rare " * (i % 5 == 0) + f"camelCase{i} " * (i % 3) for i in range(300)}


def rows(df):
    return sorted(map(tuple, df.collect()))


def sizes(root):
    return sum(p.stat().st_size for p in root.rglob("*.parquet"))


def test_commits_are_whole_and_snapshots_stay(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    one = log.commit({"t": Change(chunks_of(spark, {1: "a", 2: "b", 3: None}), key="file_path")})
    before = sizes(tmp_path)
    log.commit({"t": Change(chunks_of(spark, {2: "new"}), chunks_of(spark, {2: "", 3: ""}).select("file_path"), "file_path")})
    assert sizes(tmp_path) - before < before, "a commit writes what changes"
    want = [("c1", "a", "/r/1.py"), ("c2", "new", "/r/2.py")]
    assert rows(log.table("t")) == want
    assert len(rows(log.table("t", log.state(one.number)))) == 3, "readers of the older commit still work"
    log.compact("t")
    assert rows(log.table("t")) == want and len(log.state().tables["t"]) == 1
    log.commit({"t": Change(gone=chunks_of(spark, {1: ""}).select("file_path"), key="file_path")})
    assert rows(log.table("t")) == want[1:] and log.clean(1) >= 2 and rows(log.table("t")) == want[1:]
    log.reset()
    with pytest.raises(FileNotFoundError):
        log.table("t")


def test_concurrent_commits_all_count_or_are_refused(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.commit({"t": Change(chunks_of(spark, {0: "x"}), key="file_path"), "whole": Change(chunks_of(spark, {0: "x"}))})
    errors = []

    def add(i):
        try:
            Log(spark, str(tmp_path)).commit({"t": Change(chunks_of(spark, {i: "y"}), key="file_path")})
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(1, 7)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and log.table("t").count() == 7 and log.numbers() == list(range(1, 8))
    seen = log.state()
    log.commit({"whole": Change(chunks_of(spark, {1: "first"}))}, since=seen)
    with pytest.raises(Conflict):
        log.commit({"whole": Change(chunks_of(spark, {2: "second"})), "t": Change(chunks_of(spark, {99: "z"}), key="file_path")}, since=seen)
    assert rows(log.table("whole")) == [("c1", "first", "/r/1.py")] and log.table("t").count() == 7, "nothing of a refused commit shows"
    assert log._put(log.state()) is False, "a number is taken once"


def test_streamed_batches_count_once(spark, tmp_path):
    events = tmp_path / "events"
    log = Log(spark, str(tmp_path / "index"))
    base = chunks_of(spark, TEXTS)
    log.commit({"chunks": Change(base, key="file_path"), **postings.changes(base)})
    kind = "path string, at timestamp, action string, content string"
    t0 = datetime(2024, 1, 1)
    chunker = lambda f: f.select(F.concat(F.lit("n"), F.regexp_extract("path", r"(\d+)", 1)).alias("id"), "content", F.col("path").alias("file_path"))
    feed = [[("/r/3.py", t0, "update", "brandnew text"), ("/r/4.py", t0, "delete", None)], [("/r/3.py", t0, "update", "again brandnew"), ("/r/3.py", t0 + timedelta(seconds=1), "update", "final brandnew"), ("/r/new1000.py", t0, "update", "brandnew too")]]
    before = sizes(tmp_path / "index")
    for batch in feed:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(events))
        live.keep_live(spark.readStream.schema(kind).parquet(str(events)), log, chunker, str(tmp_path / "cp")).awaitTermination(300)
    assert sizes(tmp_path / "index") - before < before
    texts = {r.file_path: r.content for r in log.table("chunks").collect()}
    assert texts == {f"/r/{i}.py": t for i, t in TEXTS.items() if i not in (3, 4)} | {"/r/3.py": "final brandnew", "/r/new1000.py": "brandnew too"}
    state = log.state()
    assert log.commit({"chunks": Change(chunks_of(spark, {7: "twice"}), key="file_path")}, stream="files", batch=state.applied["files"]).number == state.number
    asked = spark.createDataFrame([(1, "brandnew word3"), (2, "text common")], "query_id bigint, text string")
    assert rows(postings.PostingIndex(log).search(asked, 8)) == rows(ranking.bm25(log.table("chunks"), asked, 8)), "postings equal those of a rebuild"


def test_postings_by_bound_equal_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    chunks = chunks_of(spark, TEXTS | {900: None, 901: "", 902: "common " * 50})
    log = Log(spark, str(tmp_path))
    log.commit(postings.changes(chunks))
    index = postings.PostingIndex(log)
    assert rows(index.flat()) == sorted(tuple(r) for r in ranking.postings(chunks).collect())
    queries = {1: "rare", 2: "word3 rare rare", 3: "common", 4: "nothing here", 5: "camelCase7 common word1", 6: ""}
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    for n in (1, 5, 1000):
        want = rows(ranking.bm25(chunks, asked, n))
        assert rows(index.search(asked, n)) == want == rows(index.search(asked, n, prune=False))
    one = spark.createDataFrame([(1, "rare")], "query_id bigint, text string")
    read, all_of = index.read_share(one)
    assert read == 1 and all_of == 64
    assert len(index.blocks(one.selectExpr("'rare' AS term")).where("bucket >= 0").select("bucket").distinct().collect()) <= 1


def test_sql_functions(spark):
    kind = CHUNK + ", symbol_name string, symbol_kind string, language string, start_line int, end_line int, source string"
    data = [(f"c{i}", t, f"/r/{i}.py", f"f{i}", "function", "python", i, i + 1, "ab"[i % 2]) for i, t in TEXTS.items()] + [("d", "rare rare word1 " * 20, "/r/x.py", "x", "class", "python", 1, 2, "a"), ("e", "rare rare word1 " * 20, "/r/y.py", "y", "class", "python", 1, 2, "a")]
    engine = Engine(spark, spark.createDataFrame(data, kind))
    names = sqlapi.register(engine, "t")
    assert {"t_chunks", "t_search", "t_search_in", "t_sources"} <= set(names)
    got = spark.sql("SELECT file, symbol, score, rank FROM t_search('rare word1') LIMIT 5").collect()
    want = engine.hit_rows(engine.search("rare word1", 5).orderBy("rank")).collect()
    assert [(r.file, r.symbol, r.score) for r in got] == [(r.file, r.symbol, r.score) for r in want] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    asked = spark.createDataFrame([(1, "rare word1"), (2, None), (3, ""), (4, "camelCase7"), (5, "rare word1")], "n int, q string")
    asked.createOrReplaceTempView("t_asked")
    joined = spark.sql("SELECT n, s.id, s.rank FROM t_asked, LATERAL t_search(q) AS s WHERE s.rank <= 4")
    each = {n: [r.id for r in engine.search(q, 4).orderBy("rank").collect()] for n, q in ((1, "rare word1"), (4, "camelCase7"), (5, "rare word1"))}
    found = {}
    for r in sorted(joined.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.n, []).append(r.id)
    assert found == each
    assert "CartesianProduct" not in joined._jdf.queryExecution().toString()
    assert {r.source for r in spark.sql("SELECT * FROM t_search_in('rare word1', 'b')").collect()} == {"b"}
    assert spark.sql("SELECT * FROM t_search('rare')").count() <= 50


def test_tokens_in_sql(spark):
    texts = ["fooBar HTTPServer2 a_b", "", None, "xmlHttpRequest  ABC abcDEF ÄÖ 9a", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    both = df.select(tx.tokens(F.col("q")).alias("a"), F.expr(sqlapi.TOKENS.format("q")).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_data_source_pushes_filters(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    first = log.commit({"chunks": Change(chunks_of(spark, TEXTS), key="file_path")})
    log.commit({"chunks": Change(chunks_of(spark, {1: "new one"}), chunks_of(spark, {1: "", 2: ""}).select("file_path"), "file_path")})
    datasource.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW idx USING siltstone OPTIONS (index '{tmp_path}')")
    assert rows(spark.table("idx")) == rows(log.table("chunks"))
    some = spark.sql("SELECT id FROM idx WHERE file_path IN ('/r/1.py', '/r/2.py', '/r/7.py') AND id >= 'c1' AND content LIKE '%e%'")
    assert rows(some) == [("c1",), ("c7",)]
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "In(file_path, [/r/1.py,/r/2.py,/r/7.py])" in plan and "GreaterThanOrEqual(id,c1)" in plan and "StringContains(content,e)" in plan
    old = spark.read.format("siltstone").options(index=str(tmp_path), number=str(first.number)).load()
    assert old.count() == len(TEXTS) and old.where("content LIKE '%camelCase2 %' AND length(id) > 1").count() == 1
    with pytest.raises(Exception, match="no table nothing"):
        spark.read.format("siltstone").options(index=str(tmp_path), table="nothing").load()


def test_vector_index_prunes_and_stays_exact(spark, tmp_path):
    import numpy as np

    from siltstone.operators import vectors

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 4
    data = [(i, (v / np.linalg.norm(v)).tolist()) for i in range(600) for v in [centres[i % 20] + rng.normal(size=8) * 0.2]] + [(1000 + i, data_0) for i, data_0 in enumerate([[1.0] + [0.0] * 7] * 200)]
    frame = spark.createDataFrame([*data, (5000, None)], "id bigint, vector array<float>")
    log = Log(spark, str(tmp_path))
    index = vectors.store(log, frame, 24)
    asked = frame.where("id % 50 = 0").selectExpr("id AS query_id", "vector")
    want = rows(ranking.dense(frame, asked, 5))
    assert rows(index.search(asked, 5)) == want and want
    one = asked.limit(1)
    assert rows(index.search(one, 5)) == rows(ranking.dense(frame, one, 5))
    assert len(index.read) < len(index.cells), "cells that a bound rules out are not read"
    files = len(index.blocks(sorted(index.read)).inputFiles()), len(index.blocks().inputFiles())
    probes = index.calibrate(asked, 0.95, 5)
    found = {r[:2] for r in rows(index.search(asked, 5, probes).select("query_id", "id"))}
    assert probes < len(index.cells) and len(found & {r[:2] for r in want}) >= 0.95 * len(want)
    assert files[1] >= files[0]
    assert sorted(r.id for r in index.flat().collect()) == sorted(i for i, _ in data)
    empty = vectors.store(Log(spark, str(tmp_path / "none")), frame.limit(0))
    assert empty.search(asked).count() == 0


def test_postings_meet_queries_by_chunk_and_pairs_are_never_rows(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    chunks = chunks_of(spark, TEXTS)
    log.commit(postings.changes(chunks))
    asked = spark.createDataFrame([(q, f"common rare word{q} text") for q in range(9)], "query_id bigint, text string")
    found = postings.PostingIndex(log).search(asked, 5)
    assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(ranking.bm25(chunks, asked, 5))


def test_sql_search_exchanges_the_best_of_parts_not_pairs(spark, tmp_path, monkeypatch):
    """Pairs of texts and chunks, and whole postings, went through three exchanges."""
    monkeypatch.setattr(sqlapi, "PART", 100)
    monkeypatch.setattr(postings, "BLOCK", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # the stored postings are over it, as large tables are
    try:
        log = Log(spark, str(tmp_path))
        sourced = lambda texts: chunks_of(spark, texts).withColumn("source", F.lit("a"))
        chunks = sourced(TEXTS | {901: "rare word1 gone " * 20, 902: "rare word1 same body " * 20, 903: " rare word1 same body " * 20})
        log.commit({"chunks": Change(chunks, key="id"), **postings.changes(chunks)})
        gone, fresh = chunks.where("id IN ('c7', 'c901')"), sourced({7: "rare new word5"})
        log.commit({"chunks": Change(fresh, gone.select("id"), "id"), **postings.changes(fresh, gone)})
        engine = Engine(spark, log.table("chunks"), postings=postings.PostingIndex(log))
        counts = {r.term: r.df for r in ranking.term_counts(engine.chunks.select("id", tx.tokens(F.col("content")).alias("terms"))).collect() if r.term}
        assert {(r.term, r.df) for r in engine.postings.flat(df=True).select("term", "df").collect()} == set(counts.items())
        sqlapi.register(engine, "few")
        asked = spark.createDataFrame([(n, f"common rare word{n}") for n in range(8)], "n int, q string")
        asked.write.parquet(str(tmp_path / "asked"))
        spark.read.parquet(str(tmp_path / "asked")).createOrReplaceTempView("few_asked")
        found = spark.sql("SELECT n, s.id, s.score, s.rank FROM few_asked, LATERAL few_search(q) AS s WHERE s.rank <= 5")
        want = ranking.retrieve(engine.chunks, asked.selectExpr("n AS query_id", "q AS text"), 5, "sparse").select("query_id", "id", "score", "rank")
        assert rows(found) == rows(want)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and ("(id#" in line and ", q#" in line or "(part#" in line or "(term#" in line)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_chunk_is_counted_without_an_exchange(spark):
    chunks = chunks_of(spark, TEXTS | {900: None, 901: "", 902: "Common common cOmmon"})
    post = ranking.postings(chunks)
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    each = chunks.select("id", tx.tokens(F.col("content")).alias("t")).select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    assert rows(post) == rows(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
