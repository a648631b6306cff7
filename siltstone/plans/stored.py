"""Registered queries over stored indexes: each writes an index of the tables to the shared folder, then reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import postings, ranking, vectors
from siltstone.operators.lineage import shared_dir
from siltstone.plans import sqlapi
from siltstone.plans.engine import Engine
from siltstone.sources.store import Change, Log

from .catalog import ASKED, ASKED_VECTORS, CHUNKS, EDGES, FLAT, NODES, SEEDS, SYMBOLS, VECTORS, _EDITED, _HYBRID, _dedup_sql, bm25_sql, dense_sql, inputs, query, rrf_sql


def new_log(spark: SparkSession) -> Log:
    return Log(spark, f"{shared_dir(spark)}/siltstone-index/{uuid.uuid4().hex}")


def stored_index(spark: SparkSession, chunks: DataFrame) -> Log:
    """A log with the chunks and their postings."""
    log = new_log(spark)
    log.commit({"chunks": Change(chunks, key="id"), **postings.changes(chunks)})
    return log


@query(f"WITH {bm25_sql(CHUNKS, ASKED, 10)} SELECT query_id, id, score, rank FROM bm25")
def postings_search(spark, sf_dir):
    """bm25_topk from stored blocks."""
    chunks, asked = inputs(spark, sf_dir, CHUNKS, ASKED)
    return postings.PostingIndex(stored_index(spark, chunks.select("id", "content"))).search(asked, 10)


_SHORT = r"SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{4,}')[1:2], ' ') AS text FROM benchmark"
_SHORT_SPARK = r"SELECT item_id AS query_id, array_join(slice(regexp_extract_all(text, '([A-Za-z]{4,})', 1), 1, 2), ' ') AS text FROM benchmark"


@query(f"WITH {bm25_sql(CHUNKS, _SHORT, 5)} SELECT query_id, id, score, rank FROM bm25")
def postings_search_short(spark, sf_dir):
    """Two words a query: most blocks of common words are left unread."""
    chunks, asked = inputs(spark, sf_dir, CHUNKS, _SHORT_SPARK.replace("\\", "\\\\"))
    return postings.PostingIndex(stored_index(spark, chunks.select("id", "content"))).search(asked, 5)


@query(f"WITH {bm25_sql(_EDITED, ASKED, 10)} SELECT query_id, id, score, rank FROM bm25")
def postings_changed(spark, sf_dir):
    """Searches after a tenth of the chunks were edited and a tenth removed, by what those alone write."""
    before, after, asked = inputs(spark, sf_dir, CHUNKS, _EDITED, ASKED)
    log = stored_index(spark, before.select("id", "content"))
    gone = before.where("id % 10 <= 1").select("id", "content")
    fresh = after.where("id % 10 = 1").select("id", "content")
    log.commit({"chunks": Change(fresh, gone.select("id"), "id"), **postings.changes(fresh, gone)})
    return postings.PostingIndex(log).search(asked, 10)


@query(f"SELECT id, content FROM ({_EDITED})")
def log_merge(spark, sf_dir):
    """Chunks read through a base, two commits of changes with tombstones, and a merge of the segments in between."""
    before, after = inputs(spark, sf_dir, CHUNKS, _EDITED)
    log = new_log(spark)
    log.commit({"chunks": Change(before.select("id", "content"), key="id")})
    log.commit({"chunks": Change(gone=before.where("id % 10 = 0").select("id"), key="id")})
    log.compact("chunks")
    edited = after.where("id % 10 = 1").select("id", "content")
    log.commit({"chunks": Change(edited, edited.select("id"), "id")})
    return log.table("chunks")


@query(f"WITH {_HYBRID}, {rrf_sql(['dense', 'bm25'], 30)}, {_dedup_sql('fused', 5)} SELECT * FROM cut")
def search_from_index(spark, sf_dir):
    """search_batch with the postings and bodies of a stored index."""
    chunks, asked, vectors, asked_vectors = inputs(spark, sf_dir, CHUNKS, ASKED, VECTORS, ASKED_VECTORS)
    log = stored_index(spark, chunks)
    return ranking.retrieve(log.table("chunks"), asked, 5, "hybrid", vectors, asked_vectors, post=postings.PostingIndex(log)).select("query_id", "id", "score", "rank")


@query(f"WITH asked2 AS (SELECT row_number() OVER (ORDER BY text) AS query_id, text FROM (SELECT DISTINCT text FROM benchmark)), {bm25_sql(CHUNKS, 'SELECT * FROM asked2', 55)}, {_dedup_sql('bm25', 3)} SELECT b.item_id, r.id, r.score, r.rank FROM benchmark AS b JOIN asked2 USING (text) JOIN cut AS r USING (query_id)")
def search_lateral(spark, sf_dir):
    """The search as a table function, called for each row of a table in SQL."""
    chunks, asked = inputs(spark, sf_dir, CHUNKS, ASKED)
    name = f"lateral_{uuid.uuid4().hex[:8]}"
    log = stored_index(spark, chunks)
    sqlapi.register(Engine(spark, log.table("chunks"), postings=postings.PostingIndex(log)), name)
    asked.createOrReplaceTempView(f"{name}_asked")
    return spark.sql(f"SELECT a.query_id AS item_id, s.id, s.score, s.rank FROM {name}_asked AS a, LATERAL {name}_search(a.text) AS s WHERE s.rank <= 3")


@query(f"WITH {SEEDS}, ops AS (SELECT unnest(['callers', 'callees', 'subclasses', 'superclasses']) AS operation), e AS (SELECT *, CASE WHEN relation = 'calls' THEN 'callers' ELSE 'subclasses' END AS operation, target AS key FROM edges WHERE relation IN ('calls', 'inherits') UNION ALL SELECT *, CASE WHEN relation = 'calls' THEN 'callees' ELSE 'superclasses' END, source FROM edges WHERE relation IN ('calls', 'inherits')) SELECT s.symbol, e.operation, {FLAT} FROM ops JOIN e USING (operation) JOIN seeds AS s ON s.id = e.key JOIN nodes AS f ON f.id = e.source JOIN nodes AS t ON t.id = e.target")
def graph_lateral(spark, sf_dir):
    """The graph function for each pair of a symbol and an operation."""
    chunks, nodes, edges, symbols = inputs(spark, sf_dir, CHUNKS, NODES, EDGES, SYMBOLS)
    name = f"lateral_{uuid.uuid4().hex[:8]}"
    sqlapi.register_graph(Engine(spark, chunks, nodes=nodes, edges=edges), name)
    symbols.distinct().createOrReplaceTempView(f"{name}_asked")
    return spark.sql(f"SELECT a.symbol, o.operation, g.* FROM {name}_asked AS a, (SELECT explode(array('callers', 'callees', 'subclasses', 'superclasses')) AS operation) AS o, LATERAL {name}_graph(o.operation, a.symbol) AS g")


@query(f"WITH {dense_sql(VECTORS, ASKED_VECTORS, 10)} SELECT query_id, id, score, rank FROM dense")
def vector_index_exact(spark, sf_dir):
    """dense_topk from stored cells, those left out whose bound rules them out."""
    rows, asked = inputs(spark, sf_dir, VECTORS, ASKED_VECTORS)
    return vectors.store(new_log(spark), rows).search(asked, 10)


@query("SELECT count(*) AS n_queries, true AS enough FROM benchmark JOIN embeddings ON vec_id = item_id")
def vector_index_recall(spark, sf_dir):
    """Whether as few cells as a calibration says find 0.95 of the exact ten hits of all queries."""
    rows, asked = inputs(spark, sf_dir, VECTORS, ASKED_VECTORS)
    index = vectors.store(new_log(spark), rows)
    probes = index.calibrate(asked.orderBy(F.xxhash64("query_id")).limit(200), 0.97)
    found = index.search(asked, 10, probes).select("query_id", "id", F.lit(1).alias("found"))
    exact = ranking.dense(rows, asked, 10).join(found, ["query_id", "id"], "left")
    return exact.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("found") >= 0.95 * F.count("*")).alias("enough"))
