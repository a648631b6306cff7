"""Further registered queries: projections, windows of words, saved tokens, combined tools, joins for consumers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import graph, ranking, upkeep
from siltstone.sources import files, pdf

from .catalog import _HEAD, _PREVIEW, ASKED, CHUNKS, CODE, EDGES, FLAT, NODES, SEEDS, SYMBOLS, bm25_sql, graph_of, inputs, query

_SUFFIX = "SELECT doc_id, 'dir/' || source || CASE doc_id % 8 WHEN 0 THEN '/a.PY' WHEN 1 THEN '/b.tar.go' WHEN 2 THEN '/.hidden' WHEN 3 THEN '/plain' WHEN 4 THEN '/x.h' WHEN 5 THEN '/m.h' WHEN 6 THEN '/w.zzz' ELSE '/k.Tsx' END AS path, CASE WHEN doc_id % 8 = 5 THEN '@interface X' ELSE 'int x;' END AS content FROM documents"


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 4 THEN 'c' WHEN 5 THEN 'objc' WHEN 7 THEN 'tsx' END AS language FROM ({_SUFFIX})")
def path_language(spark, sf_dir):
    (paths,) = inputs(spark, sf_dir, _SUFFIX)
    return paths.select("doc_id", tx.language(F.col("path"), F.col("content")).alias("language"))


@query(f"SELECT doc_id, path FROM ({_SUFFIX}) WHERE doc_id % 8 IN (0, 1, 7) AND NOT contains(path, 'src1')")
def candidate_files(spark, sf_dir):
    (paths,) = inputs(spark, sf_dir, _SUFFIX)
    return paths.where(files.is_candidate(F.col("path"), ["py", ".GO", "tsx"], ["src1", ""])).select("doc_id", "path")


_SIZE, _OVERLAP = 64, 8
_WORDS = r"regexp_extract_all(coalesce(content, ''), '[^\s]+')"


@query(f"""WITH w AS (SELECT id, {_WORDS} AS words FROM ({CHUNKS})), s AS (SELECT id, words, unnest(range(0, greatest(CAST(ceil((len(words) - {_OVERLAP}) / {_SIZE - _OVERLAP}.0) AS BIGINT), CASE WHEN len(words) > 0 THEN 1 ELSE 0 END))) AS nth FROM w)
SELECT id, CAST(nth AS INT) AS nth, array_to_string(words[nth * {_SIZE - _OVERLAP} + 1 : nth * {_SIZE - _OVERLAP} + {_SIZE}], ' ') AS content FROM s""")
def word_windows(spark, sf_dir):
    """Windows of words with an overlap, without Python."""
    (chunks,) = inputs(spark, sf_dir, CHUNKS)
    words = chunks.select("id", F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"([^\s]+)"), 1).alias("words"))
    n = F.greatest(F.ceil((F.size("words") - _OVERLAP) / (_SIZE - _OVERLAP)), F.when(F.size("words") > 0, 1).otherwise(0)).cast("int")
    each = words.withColumn("n", n).where("n > 0").select("id", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    return each.select("id", "nth", F.array_join(F.slice("words", F.col("nth") * (_SIZE - _OVERLAP) + 1, _SIZE), " ").alias("content"))


@query(f"SELECT id, '/corpus' AS file_path, content, coalesce(kind, 'text') AS symbol_kind, 1 AS start_line FROM ({CODE}) WHERE content IS NOT NULL")
def node_rows(spark, sf_dir):
    (code,) = inputs(spark, sf_dir, CODE)
    return code.where("content is not null").select("id", F.lit("/corpus").alias("file_path"), "content", F.coalesce("kind", F.lit("text")).alias("symbol_kind"), F.lit(1).alias("start_line"))


@query(f"SELECT CAST(sum(length(coalesce(content, '')) // 4) AS BIGINT) AS full_tokens, count(*) AS n FROM ({CODE})")
def outline_tokens(spark, sf_dir):
    (code,) = inputs(spark, sf_dir, CODE)
    return upkeep.outline_savings(code).select("full_tokens").crossJoin(code.agg(F.count("*").alias("n")))  # two rows of one row each


@query(f"""WITH {SEEDS}, {bm25_sql(CHUNKS, "SELECT row_number() OVER (ORDER BY symbol) AS query_id, symbol AS text FROM (SELECT DISTINCT symbol FROM asked)", 10)},
n AS (SELECT row_number() OVER (ORDER BY symbol) AS query_id, symbol FROM (SELECT DISTINCT symbol FROM asked)),
u AS (SELECT s.symbol, f.file, f.start_line, 0 AS step, f.label FROM seeds AS s JOIN edges AS e ON e.target = s.id AND relation = 'calls' JOIN nodes AS f ON f.id = e.source
 UNION ALL SELECT n.symbol, c.file_path, 1, 1, '' FROM bm25 AS r JOIN n USING (query_id) JOIN ({CHUNKS}) AS c ON c.id = r.id)
SELECT symbol, file, start_line, step, label FROM u QUALIFY row_number() OVER (PARTITION BY symbol, file, start_line ORDER BY step, label) = 1""")
def find_usages(spark, sf_dir):
    """Callers by the graph, then search hits, one row for each file and line."""
    nodes, edges, symbols, chunks = inputs(spark, sf_dir, NODES, EDGES, SYMBOLS, CHUNKS)
    calls = graph.callers(nodes, edges, symbols, None).select("symbol", F.col("from_file").alias("file"), F.col("from_start_line").alias("start_line"), F.lit(0).alias("step"), F.col("from_symbol").alias("label"))
    asked = symbols.distinct().withColumn("query_id", F.row_number().over(Window.orderBy("symbol")))  # as many rows as symbols asked for
    hits = ranking.bm25(chunks, asked.select("query_id", F.col("symbol").alias("text")), 10).join(asked, "query_id").join(chunks.select("id", "file_path"), "id")
    hits = hits.select("symbol", F.col("file_path").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("step"), F.lit("").alias("label"))
    best = calls.unionByName(hits).groupBy("symbol", "file", "start_line").agg(F.min(F.struct("step", "label")).alias("u"))
    return best.select("symbol", "file", "start_line", "u.step", "u.label")


@query(f"WITH {SEEDS} SELECT DISTINCT s.symbol, {FLAT} FROM edges AS e JOIN seeds AS s ON s.id = e.target JOIN nodes AS f ON f.id = e.source JOIN nodes AS t ON t.id = e.target WHERE relation = 'calls' QUALIFY row_number() OVER (PARTITION BY s.symbol ORDER BY f.label, t.label, f.file, t.file, f.start_line, t.start_line, relation) <= 5")
def callers_limited(spark, sf_dir):
    return graph.callers(*graph_of(spark, sf_dir), limit=5)


@query(f"""WITH nodes AS ({NODES}), {bm25_sql(CHUNKS, ASKED, 3)} SELECT r.query_id, r.id, n.label FROM bm25 AS r JOIN nodes AS n ON n.id = 'fn_' || r.id""")
def graph_search_join(spark, sf_dir):
    nodes, chunks, asked = inputs(spark, sf_dir, NODES, CHUNKS, ASKED)
    hits = ranking.bm25(chunks, asked, 3)
    return hits.join(nodes.withColumnRenamed("id", "node_id"), F.concat(F.lit("fn_"), F.col("id")) == F.col("node_id")).select("query_id", "id", "label")


_TARGETS = "SELECT o_orderstatus AS source, o_orderpriority AS target, 'calls' AS relation, CAST(NULL AS STRING) AS confidence, o_orderpriority AS module, CAST(NULL AS STRING) AS base_kind, '' AS from_file, 1 AS from_line, o_orderkey AS ord FROM orders"


@query(f"SELECT target AS id, target AS label, 'external' AS kind, '' AS file FROM ({_TARGETS}) GROUP BY target")
def external_stubs(spark, sf_dir):
    rows, nodes = inputs(spark, sf_dir, _TARGETS, NODES)
    _, stubs = graph.upsert_edges(rows, nodes)
    return stubs.select("id", "label", "kind", "file")


_RENAMED = "SELECT 'fn_' || (l_partkey % 500) AS id, 'L' || l_linenumber AS label, 'function' AS kind, '' AS subkind, 'f' || l_suppkey AS file, l_linenumber AS start_line, l_linenumber AS end_line, '' AS lang_key, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord FROM lineitem"


@query(f"SELECT id, arg_max(label, ord) AS label, arg_max(file, ord) AS file FROM ({_RENAMED}) GROUP BY id")
def node_upsert(spark, sf_dir):
    (rows,) = inputs(spark, sf_dir, _RENAMED)
    return graph.upsert_nodes(rows).select("id", "label", "file")


@query("SELECT doc_id, 'page_' || lpad(CAST(doc_id % 9999 + 1 AS VARCHAR), 4, '0') || '.md' AS file FROM documents")
def page_names(spark, sf_dir):
    (docs,) = inputs(spark, sf_dir, "SELECT doc_id FROM documents")
    return docs.select("doc_id", pdf.page_file(F.col("doc_id") % 9999 + 1).alias("file"))


_PAGED = r"SELECT '/pdf/' || doc_id || '.pdf' AS path, text FROM documents"


@query(rf"""WITH p AS (SELECT path, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS page FROM ({_PAGED}) WHERE length(coalesce(text, '')) >= 100)
SELECT path, CAST(page AS INT) AS page, 'page_' || lpad(CAST(page AS VARCHAR), 4, '0') || '.md' AS file, text FROM p""")
def pdf_pages(spark, sf_dir):
    """Pages of files, those with too little text left out; a line of a document stands for a page."""
    (docs,) = inputs(spark, sf_dir, _PAGED)
    read = docs.select("path", F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    told = read.withColumns({"encrypted": F.lit(False), "size_mb": F.lit(0.1), "total_pages": F.size("pages"), "error": F.lit(None).cast("string")})
    return pdf.page_rows(told.withColumn("status", pdf.status_of(max_pages=1 << 30)))


_NEW_NAMES = "SELECT p_partkey AS id, ' _' || p_brand || '..' || p_name || '__ ' || p_type || '.' AS raw FROM part"


@query(rf"SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace('stem_' || regexp_replace(raw, '^[_.]+|[_.]+$', '', 'g'), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_+', '_', 'g'), '^_+', ''), '_+$', '')) AS node_id FROM ({_NEW_NAMES})")
def node_ids(spark, sf_dir):
    (names,) = inputs(spark, sf_dir, _NEW_NAMES)
    return names.select("id", tx.node_id(F.lit("_stem."), F.col("raw")).alias("node_id"))


@query("SELECT CAST(count(*) AS DOUBLE) * 1725 / 1000 * 0.003 AS cost_hits, CAST(count(*) AS DOUBLE) * 4150 / 1000 * 0.003 AS cost_grep FROM benchmark")
def savings_model(spark, sf_dir):
    (asked,) = inputs(spark, sf_dir, ASKED)
    n = F.count("*").cast("double")
    return asked.agg((n * 1725 / 1000 * 0.003).alias("cost_hits"), (n * 4150 / 1000 * 0.003).alias("cost_grep"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_feedback(spark, sf_dir):
    (events,) = inputs(spark, sf_dir, "SELECT user_id, event_id, ts FROM events")
    return upkeep.last_of(events.withColumn("event_id", -F.col("event_id")), "user_id", "ts", 3).withColumn("event_id", -F.col("event_id"))


_DOC = """substr(trim(CASE WHEN contains(content, chr(34) || chr(34) || chr(34)) THEN regexp_extract(regexp_extract(content, '(?s)\"\"\"(.*?)\"\"\"', 1), '^\\s*([^\\n]*)', 1) ELSE regexp_extract(content, '(?m)^\\s*///\\s?(.*)$', 1) END), 1, 200)"""


@query(f"""WITH o AS (SELECT length(coalesce(content, '')) // 4 AS whole, length(CASE WHEN {_HEAD} = '' THEN {_PREVIEW} ELSE substr({_HEAD}, 1, 400) END || ' ' || coalesce({_DOC}, '')) // 4 AS outline FROM ({CODE}))
SELECT CAST(sum(whole) AS BIGINT) AS full_tokens, CAST(sum(outline) AS BIGINT) AS outline_tokens, round(1 - sum(outline) / CAST(sum(whole) AS DOUBLE), 6) AS saved FROM o""")
def outline_savings(spark, sf_dir):
    """Tokens of whole bodies and of their outlines, and what the outlines save."""
    (code,) = inputs(spark, sf_dir, CODE)
    return upkeep.outline_savings(code)
