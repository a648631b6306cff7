import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.__main__ import build
from siltstone.operators import chunking, postings, ranking
from siltstone.plans.engine import Engine
from siltstone.sources import files
from siltstone.sources.store import Log
from siltstone.streaming import live, watch


def test_a_folder_and_its_index(spark, tmp_path):
    root, index = tmp_path / "src", tmp_path / "index"
    root.mkdir()
    for name, body in (("a", "def alpha():\n    return 1\n"), ("b", "def beta():\n    return 2\n"), ("c", "def gamma():\n    return 3\n"), ("d", "def delta():\n    return 4\n"), ("e", "def epsilon():\n    return 5\n")):
        (root / f"{name}.py").write_text(body)
    build(spark, str(root), str(index), ["py"], [])
    log = Log(spark, str(index))
    chunker = lambda found: chunking.chunk_files(found).withColumn("source", F.lit("files"))
    run = lambda: watch.watch(spark, str(root), ["py"], log, chunker, str(tmp_path / "cp")).awaitTermination(300)
    names = lambda: sorted(r.symbol_name for r in log.table("chunks").collect())
    time.sleep(0.1)
    run()
    assert names() == ["alpha", "beta", "delta", "epsilon", "gamma"], "what the index had comes in again in its own place"
    seen = log.state().number
    (root / "a.py").write_text("def omega():\n    return 9\n")
    (root / "b.py").unlink()
    (root / "notes.txt").write_text("no source")
    time.sleep(0.1)
    run()
    assert names() == ["delta", "epsilon", "gamma", "omega"] and log.state().number == seen + 1
    engine = Engine.open(spark, str(index))
    assert engine.search("omega", 3).first().symbol_name == "omega"
    asked = engine.queries(["omega gamma"])
    assert sorted(map(tuple, postings.PostingIndex(log).search(asked, 5).collect())) == sorted(map(tuple, ranking.bm25(log.table("chunks"), asked, 5).collect()))
    run()
    assert log.state().number == seen + 1, "nothing new, nothing written"


def test_waiting_events_outlive_a_restart(spark, tmp_path):
    live.with_timers(spark)
    t0, kind = datetime(2024, 1, 1), "path string, at timestamp, action string"
    feed = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(enough):
        bursts = live.debounce_by_clock(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 1_000)
        q = bursts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
        end = time.time() + 120
        got = []
        while time.time() < end and not enough(q, got):
            time.sleep(0.3)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = sorted(map(tuple, spark.read.schema("path string, action string, n_events bigint").parquet(str(tmp_path / "out")).collect()))
        q.stop()
        return got

    feed([("a", t0, "update"), ("a", t0 + timedelta(seconds=1), "delete"), ("b", t0, "update")])
    run(lambda q, got: q.lastProgress is not None and q.lastProgress["numInputRows"] > 0 or got)
    feed([("c", t0, "update")])
    assert run(lambda q, got: len(got) >= 3) == [("a", "delete", 2), ("b", "update", 1), ("c", "update", 1)]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_feedback_is_appended(spark, tmp_path):
    path = str(tmp_path / "feedback")
    files.write_feedback(spark.createDataFrame([("find x", ["a", "b"])], "tried string, sources array<string>"), path)
    files.write_feedback(spark.createDataFrame([("2024-01-01", "y")], "at string, stuck string"), path)
    got = files.read_feedback(spark, path).collect()
    assert len(got) == 2 and all(r.at for r in got) and {r.tried for r in got} == {"find x", None}
