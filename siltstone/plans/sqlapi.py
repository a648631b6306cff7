"""SQL for a corpus: views, and table functions that take a query or a symbol, also from each row of another table.

The functions are SQL themselves, over the views. So Spark plans `FROM t, LATERAL corpus_search(t.text)` as joins over the distinct texts of t, all at
once, and nothing runs row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import graph, ranking
from siltstone.operators.lineage import checkpointed, shared_dir

from .engine import MAX_TOP_K, Engine

#: text.tokens as SQL; a test holds the two against each other.
TOKENS = """flatten(transform(filter(split(coalesce({0}, ''), '[^A-Za-z0-9]+'), x -> x <> ''), r -> CASE WHEN r = lower(r) THEN array(r) ELSE
 concat(array(lower(r)), filter(transform(split(r, '(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])'), p -> lower(p)), p -> p <> '' AND p <> lower(r))) END))"""
_HIT = {"source": "STRING", "file": "STRING", "file_path": "STRING", "symbol": "STRING", "kind": "STRING", "language": "STRING", "start_line": "INT", "end_line": "INT", "score": "DOUBLE", "rank": "INT", "content": "STRING"}
_EDGE = {"relation": "STRING", "base_kind": "STRING", "confidence": "STRING", "module": "STRING"} | {f"{s}_{c}": k for s in ("from", "to") for c, k in (("symbol", "STRING"), ("kind", "STRING"), ("file", "STRING"), ("start_line", "INT"), ("end_line", "INT"))} | {"call_site_file": "STRING", "call_site_line": "INT"}
#: Postings of a part, about; a task of a search adds up the scores of a few parts.
PART = 100_000
#: What an operation of the graph function asks: relations, and the end that the symbol is at.
OPERATIONS = {"callers": (("calls",), "to"), "callees": (("calls",), "from"), "subclasses": (("inherits",), "to"), "superclasses": (("inherits",), "from"), "imports": (("imports", "imports_from"), "from")}


def _search(name: str, avgdl: float, where: str = "") -> str:
    """Hits by rank, MAX_TOP_K at most; of equal bodies the best, as ranking.retrieve has them. A LIMIT takes the best ones.

    Scores are added up and the best of a part taken where its postings lie, so pairs of texts and chunks are not exchanged, only the best of each part.
    """
    fetch = MAX_TOP_K + ranking.HEADROOM
    return f"""
SELECT {', '.join(['id', *_HIT])} FROM (SELECT *, CAST(row_number() OVER (ORDER BY place) AS INT) AS rank FROM (
 SELECT c.*, score, place, row_number() OVER (PARTITION BY c.body ORDER BY place) AS nth FROM (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM (
   SELECT id, score, row_number() OVER (PARTITION BY part ORDER BY score DESC, id) AS own FROM (
    SELECT p.part, p.id, round(sum(a.qtf * p.weight * p.tf / (p.tf + {_length_part(avgdl)})), 6) AS score
    FROM (SELECT term, count(*) AS qtf FROM (SELECT explode({TOKENS.format('q')}) AS term) GROUP BY term) AS a
    JOIN {name}_postings AS p ON p.term = a.term {where}
    GROUP BY p.part, p.id) WHERE score > 0) WHERE own <= {fetch}) AS r JOIN {name}_hits AS c ON c.id = r.id WHERE place <= {fetch})
 WHERE nth = 1) WHERE rank <= {MAX_TOP_K} ORDER BY rank"""


def _length_part(avgdl: float, k1: float = 1.5, b: float = 0.75) -> str:
    return f"{k1} * ({1 - b} + {b} * p.dl / {avgdl!r}D)"


def _dealt(post: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """post(id, dl, term, tf, df) with part, in as many parts as n postings make, and weight, as a table in buckets by part: searches find a chunk's postings together.

    weights(df, weight), which go to all tasks, are fewer than the square root of twice the postings.
    """
    spark, name = post.sparkSession, f"postings_{uuid.uuid4().hex}"
    parts = max(1, min(ranking.MAX_TASKS, -(-n // PART)))
    dealt = post.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    weighted = dealt.join(F.broadcast(weights), "df").drop("df")
    weighted.write.bucketBy(parts, "part").sortBy("term").option("path", f"{shared_dir(spark)}/siltstone-sql/{name}").saveAsTable(name)
    return spark.table(name)


def _graph(name: str) -> str:
    return f"""
SELECT {', '.join(_EDGE)} FROM {name}_incident AS e JOIN (
 SELECT id FROM (SELECT id, nth, min(nth) OVER () AS best FROM (
  SELECT id, CASE WHEN low = lower(trim(symbol)) OR leaf = lower(trim(symbol)) THEN 0 ELSE 1 END AS nth FROM {name}_symbols WHERE trim(symbol) <> '' AND contains(low, lower(trim(symbol))))) WHERE nth = best) AS s
 ON e.key = s.id WHERE e.operation = lower(trim(operation_name))"""


def register(engine: Engine, name: str = "corpus") -> list[str]:
    """Makes the views <name>_chunks, _sources, _nodes, _edges and the table functions <name>_search(q), <name>_search_in(q, source) and <name>_graph(operation, symbol); their names.

    Scores are those of a sparse search over the engine's chunks. Terms come from the engine's stored postings if it has any; with their
    weights they are written here as a table dealt by chunk, which all searches read. A null or empty query or symbol has no rows.
    """
    spark, chunks = engine.spark, engine.chunks
    made = engine.register_views(name)
    stored = engine.postings
    post = checkpointed(ranking.postings(chunks)) if stored is None else stored.flat() if hasattr(stored, "flat") else stored
    counts = ranking.posting_counts(post, chunks)
    stats, size = ranking.term_statistics(counts)
    stats = checkpointed(stats.select("term", "df", (F.col("idf") * 2.5).alias("weight")))
    n = counts.where("term is not null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    counted = stored.flat(df=True) if hasattr(stored, "flat") else post.join(stats.select("term", "df"), "term")
    views = {"postings": _dealt(counted, stats.groupBy("df").agg(F.first("weight").alias("weight")), n), "hits": _with_id(chunks)}
    for view, df in views.items():
        df.createOrReplaceTempView(f"{name}_{view}")
    avgdl = float(size.first().avgdl or 1)
    id_kind = chunks.schema["id"].dataType.simpleString().upper()
    columns = ", ".join(f"{c} {k}" for c, k in ({"id": id_kind} | _HIT).items())
    functions = {"search": f"(q STRING) RETURNS TABLE({columns}) RETURN {_search(name, avgdl)}"}
    functions["search_in"] = f"(q STRING, source_name STRING) RETURNS TABLE({columns}) RETURN {_search(name, avgdl, f'JOIN {name}_hits AS w ON w.id = p.id AND w.source = source_name')}"
    for function, text in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{function}{text}")
    found = register_graph(engine, name) if engine.nodes is not None else []
    return sorted([*made, *[f"{name}_{f}" for f in functions], *found])


def register_graph(engine: Engine, name: str = "corpus") -> list[str]:
    """Makes the table function <name>_graph(operation, symbol), whose operations are OPERATIONS; its name. A symbol is met as graph.find_symbols does."""
    flat = graph.flat_edges(engine.edges, engine.nodes, "from", "to")
    asks = None
    for op, (relations, side) in OPERATIONS.items():
        part = flat.where(F.col("relation").isin(*relations)).select(F.lit(op).alias("operation"), F.col(side).alias("key"), *_EDGE)
        asks = part if asks is None else asks.unionByName(part)
    asks.createOrReplaceTempView(f"{name}_incident")
    engine.nodes.where(~F.col("kind").isin(*graph.NOT_SYMBOLS)).select("id", F.lower("label").alias("low"), F.lower(tx.leaf(F.col("label"))).alias("leaf")).createOrReplaceTempView(f"{name}_symbols")
    columns = ", ".join(f"{c} {k}" for c, k in _EDGE.items())
    engine.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_graph(operation_name STRING, symbol STRING) RETURNS TABLE({columns}) RETURN {_graph(name)}")
    return [f"{name}_graph"]


def _with_id(chunks: DataFrame) -> DataFrame:
    """The chunks in the row format of the interface, with their id, and body, which is the same for equal bodies of MIN_BODY characters or more."""
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in chunks.columns else F.lit(d)
    texts = {"source": "source", "symbol": "symbol_name", "kind": "symbol_kind", "language": "language", "content": "content"}
    numbers = {"start_line": "start_line", "end_line": "end_line"}
    stripped = F.regexp_replace(has("content", ""), r"^\s+|\s+$", "")
    body = F.when(F.length(stripped) >= ranking.MIN_BODY, F.sha2(stripped, 256)).otherwise(F.concat(F.lit("id "), F.col("id").cast("string")))
    return chunks.select("id", body.alias("body"), tx.basename(F.col("file_path")).alias("file"), "file_path", *[has(c, "").alias(n) for n, c in texts.items()], *[has(c, 0).cast("int").alias(n) for n, c in numbers.items()])
