"""One object for a corpus: its chunk table, vectors, graph and sources, with searches, lookups and rows for SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import analytics, graph, ranking, upkeep
from siltstone.operators.postings import PostingIndex
from siltstone.sources import store

MAX_TOP_K, MAX_BATCH, MAX_EDGES = 50, 100, 200
# The score a first hit needs in a deep search, by mode.
THRESHOLDS = {"dense": 0.45, "hybrid": 0.012, "sparse": 3.0}
OPERATIONS = ("find_symbol", "callers", "callees", "subclasses", "superclasses", "imports", "neighbors", "path", "nodes_in_file", "transitive_callers")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


@dataclass
class Engine:
    """chunks(id, content, file_path, symbol_name, symbol_kind, language, start_line, end_line[, source]); vectors(id, vector); nodes and edges as in operators.graph."""

    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    embed: object = None  # queries(query_id, text) -> (query_id, vector)
    reranker: object = None
    options: dict = field(default_factory=dict)
    postings: DataFrame | PostingIndex | None = None  # stored postings of chunks: searches then don't read the texts for their terms
    broken: dict[str, str] = field(default_factory=dict)  # sources that could not be opened, and why

    @classmethod
    def open(cls, spark: SparkSession, index: str, **more) -> Engine:
        """The engine of a stored index."""
        log = store.Log(spark, index)
        state = log.state()
        if state is None:
            raise FileNotFoundError(f"no index in {index}")
        graphs = {t: log.table(t, state) for t in ("nodes", "edges") if t in state.tables}
        return cls(spark, log.table("chunks", state), postings=PostingIndex(log, state), **graphs, **more)

    @classmethod
    def open_all(cls, spark: SparkSession, indexes: dict[str, str], **more) -> Engine:
        """One engine over the chunks of several stored indexes, by the name of the source; those that can't be opened are listed in broken and left out."""
        chunks, broken = None, {}
        for name, index in indexes.items():
            try:
                part = store.read_tables(spark, index)["chunks"].withColumn("source", F.lit(name))
            except (FileNotFoundError, PySparkException) as e:
                broken[name] = str(e)
                continue
            chunks = part if chunks is None else chunks.unionByName(part, allowMissingColumns=True)
        if chunks is None:
            raise FileNotFoundError(f"no source could be opened: {broken}")
        return cls(spark, chunks, broken=broken, **more)

    @property
    def mode(self) -> str:
        return self.options.get("mode", "hybrid" if self.vectors is not None and self.embed else "sparse")

    def queries(self, texts: list[str]) -> DataFrame:
        asked = [(i, t) for i, t in enumerate(texts) if t and t.strip()]
        if not asked:
            raise ValueError("no query")
        return self.spark.createDataFrame(asked, "query_id bigint, text string")

    def search_batch(self, queries: list[str] | DataFrame, top_k: int = 5, mode: str | None = None, **filters) -> DataFrame:
        """The hits of many queries; each has those that it would have alone."""
        asked = self.queries(queries) if isinstance(queries, list) else queries
        mode = mode or self.mode
        vectors = self.embed(asked) if mode != "sparse" else None
        return ranking.retrieve(self.chunks, asked, clamp(top_k, 1, MAX_TOP_K), mode, self.vectors, vectors, self.reranker, post=self.postings, **filters)

    def search(self, query: str, top_k: int = 5, **filters) -> DataFrame:
        return self.search_batch([query], top_k, **filters)

    def search_all(self, queries: list[str] | DataFrame, top_k: int = 5, mode: str | None = None, **filters) -> DataFrame:
        """Searches each source on its own in the engine's mode and fuses their rankings; with a reranker, it orders the union. A hit's key is its source and id."""
        asked = self.queries(queries) if isinstance(queries, list) else queries
        mode = mode or self.mode
        vectors = self.embed(asked) if mode != "sparse" else None
        return ranking.retrieve_all(self.chunks, asked, clamp(top_k, 1, MAX_TOP_K), mode, self.vectors, vectors, self.reranker, **filters)

    def deep_search_all(self, variants: list[str], top_k: int = 5, min_score: float | None = None, min_results: int = 2, **filters) -> DataFrame:
        """deep_search over all sources. The scores are those of search_all: fused ranks, or the reranker's, for which 0 is enough."""
        self._check(variants)
        threshold = min_score if min_score is not None else 0.0 if self.reranker else THRESHOLDS["hybrid"]
        return self._first_strong(variants, self.search_all(list(variants), top_k, **filters), threshold, min_results)

    def deep_search(self, variants: list[str], top_k: int = 5, mode: str | None = None, min_score: float | None = None, min_results: int = 2, thresholds: dict | None = None, **filters) -> DataFrame:
        """The hits of the first variant that passes, else of the best; see ranking.deep_search."""
        self._check(variants)
        mode = mode or self.mode
        if mode not in THRESHOLDS:
            raise ValueError(f"mode {mode!r}")
        threshold = min_score if min_score is not None else (thresholds or {}).get(mode, THRESHOLDS[mode])
        return self._first_strong(variants, self.search_batch(list(variants), top_k, mode, **filters), threshold, min_results)

    @staticmethod
    def _check(variants: list[str]) -> None:
        if not isinstance(variants, (list, tuple)):
            raise TypeError("variants are a list")
        if not variants or any(not v or not v.strip() for v in variants):
            raise ValueError("variants are texts, one at least")

    def _first_strong(self, variants: list[str], hits: DataFrame, threshold: float, min_results: int) -> DataFrame:
        order = self.spark.createDataFrame([(0, i + 1, i) for i in range(len(variants))], "search_id bigint, variant bigint, query_id bigint")
        chosen = ranking.deep_search(hits, order, threshold, min_results)
        return chosen.join(hits, F.col("best_variant") == F.col("query_id") + 1, "left")

    def find_similar(self, snippet: str, top_k: int = 10) -> DataFrame:
        """Chunks near a text by vectors, without those that are the text itself."""
        text = snippet[:2000]
        if not text.strip():
            return self.chunks.limit(0)
        near = ranking.dense(self.vectors, self.embed(self.queries([text])), top_k + 1).join(self.chunks, "id")
        return ranking.top(near.where(F.trim("content") != text.strip()).drop("rank"), top_k)

    # ---- symbols ----

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        if self.nodes is None or self.edges is None:
            raise ValueError("this engine has no graph")
        return self.nodes, self.edges

    def find_definition(self, symbol: str, limit: int = 10) -> DataFrame:
        """Definitions by the graph, one for each file and label; where it knows none, search hits, tagged search_bm25."""
        nodes, _ = self._graph()
        found = graph.find_symbols(nodes, graph.asked(self.spark, symbol)).join(nodes.withColumnRenamed("id", "node_id"), "node_id").where(F.col("kind").isin("function", "class"))
        first = found.groupBy("file", "label").agg(F.min_by(F.struct("kind", "start_line", "end_line"), "node_id").alias("d")).select("file", "label", "d.*", F.lit("graph").alias("found_by"))
        hits = self.search(symbol, limit).groupBy(F.col("file_path").alias("file"), F.col("symbol_name").alias("label")).agg(F.min_by(F.struct(F.col("symbol_kind").alias("kind"), "start_line", "end_line"), "rank").alias("d")).select("file", "label", "d.*", F.lit("search_bm25").alias("found_by"))
        both = first.unionByName(hits)
        best = both.agg(F.min("found_by").alias("best"))
        return both.join(F.broadcast(best), F.col("found_by") == F.col("best")).drop("best").orderBy("file", "label").limit(limit)  # best is one row

    def find_usages(self, symbol: str, limit: int = 50) -> DataFrame:
        """Calls by the graph, then search hits that aren't the definition; one row for each file and line."""
        nodes, edges = self._graph()
        calls = graph.callers(nodes, edges, graph.asked(self.spark, symbol), None).select(F.lit(0).alias("order"), F.col("from_file").alias("file"), F.col("from_start_line").alias("start_line"), F.col("from_symbol").alias("label"))
        own = (F.lower("symbol_name") == symbol.lower()) & F.col("symbol_kind").isin(*graph.DEFINITIONS)
        hits = self.search(symbol, MAX_TOP_K).where(~F.coalesce(own, F.lit(False))).select(F.lit(1).alias("order"), F.col("file_path").alias("file"), "start_line", F.col("symbol_name").alias("label"))
        return calls.unionByName(hits).groupBy("file", "start_line").agg(F.min(F.struct("order", "label")).alias("u")).select("file", "start_line", "u.*").orderBy("order", "file", "start_line").limit(limit)

    def find_tests(self, symbol: str, limit: int = 20, pattern: str = tx.TEST_PATH) -> DataFrame:
        return self.search(symbol, limit * 3).where(F.col("file_path").rlike(pattern)).orderBy("rank").limit(limit)

    def search_diff(self, query: str, changed: list[str], top_k: int = 8) -> DataFrame:
        return self.search(query, top_k, paths=changed)

    def describe(self, symbol: str) -> dict[str, DataFrame]:
        nodes, edges = self._graph()
        asked = graph.asked(self.spark, symbol)
        return {"definition": self.find_definition(symbol, 3), "callers": graph.callers(nodes, edges, asked, 10), "callees": graph.callees(nodes, edges, asked, 10), "tests": self.find_tests(symbol, 5)}

    def impact(self, symbol: str, max_depth: int = 3, limit: int = 200) -> dict[str, DataFrame]:
        nodes, edges = self._graph()
        return {"callers": graph.transitive_callers(nodes, edges, graph.asked(self.spark, symbol), max_depth, limit), "tests": self.find_tests(symbol, 10)}

    def overview(self, top_n: int = 10, min_size: int = 3) -> dict[str, DataFrame]:
        nodes, edges = self._graph()
        return {"hubs": analytics.hubs(nodes, edges, top_n), "communities": analytics.communities(nodes, edges, min_size), "status": graph.status(nodes, edges)}

    def graph_query(self, operation: str, symbol: str = "", target: str = "", depth: int = 1, limit: int = 50) -> DataFrame:
        """One of OPERATIONS for a symbol."""
        nodes, edges = self._graph()
        if operation not in OPERATIONS:
            raise ValueError(f"operation {operation!r}: one of {', '.join(OPERATIONS)}")
        if not symbol.strip() or operation == "path" and not target.strip():
            raise ValueError("a symbol is needed")
        limit = clamp(limit, 1, MAX_EDGES)
        one = graph.asked(self.spark, symbol)
        if operation == "find_symbol":
            return graph.find_symbols(nodes, one).join(nodes.withColumnRenamed("id", "node_id"), "node_id").orderBy("node_id").limit(limit)
        if operation == "neighbors":
            return graph.limited(graph.neighbors(nodes, edges, one, depth), limit)
        if operation == "path":
            return graph.shortest_path(nodes, edges, self.spark.createDataFrame([(symbol, target)], "source_symbol string, target_symbol string"))
        if operation == "nodes_in_file":
            return graph.nodes_in_file(nodes, one.withColumnRenamed("symbol", "asked")).orderBy("file", "start_line", "id").limit(limit)
        if operation == "transitive_callers":
            return graph.transitive_callers(nodes, edges, one, max(depth, 1), limit)
        return getattr(graph, operation)(nodes, edges, one, limit)

    # ---- rows ----

    def hit_rows(self, hits: DataFrame, *more: str) -> DataFrame:
        """Hits in the row format of the interface, after the columns of more; missing values become empty strings and zeros."""
        has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in hits.columns else F.lit(d)
        return hits.select(*more, has("source", "").alias("source"), tx.basename(F.col("file_path")).alias("file"), "file_path", has("symbol_name", "").alias("symbol"), has("symbol_kind", "").alias("kind"), has("language", "").alias("language"), has("start_line", 0).cast("int").alias("start_line"), has("end_line", 0).cast("int").alias("end_line"), has("score", 0.0).alias("score"), has("content", "").alias("content"))

    def outline_rows(self, hits: DataFrame) -> DataFrame:
        """Hit rows without the content, with its signature and the first line of its documentation."""
        rows = self.hit_rows(hits)
        return rows.withColumns({"signature": tx.signature_for(F.col("content"), F.col("kind")), "doc": tx.doc_line(F.col("content"))}).drop("content")

    def source_table(self) -> DataFrame:
        """(name, type, location, chunk_count, last_update) of the sources, in the row format of the interface; what the chunks don't tell is empty."""
        has = lambda c: F.max(F.col(c).cast("string")) if c in self.chunks.columns else F.lit(None).cast("string")
        told = [F.coalesce(has(c), F.lit("")).alias(n) for c, n in (("source_type", "type"), ("location", "location"), ("updated_at", "last_update"))]
        return self.chunks.groupBy(F.col("source").alias("name")).agg(*told, F.count("*").alias("chunk_count")).select("name", "type", "location", "chunk_count", "last_update")

    def source_rows(self) -> DataFrame:
        """(name, chunk_count, health, error): the sources, and those that could not be opened."""
        good = self.chunks.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("chunk_count")).withColumns({"health": F.lit("ok"), "error": F.lit(None).cast("string")})
        if not self.broken:
            return good
        return good.unionByName(self.spark.createDataFrame([(n, None, "corrupt", e) for n, e in sorted(self.broken.items())], "name string, chunk_count bigint, health string, error string"))

    def register_views(self, prefix: str = "corpus") -> list[str]:
        """Makes chunks, sources, nodes and edges views for SQL; a search per row of a table is search_batch joined by query_id."""
        views = {"chunks": self.chunks, "sources": self.source_rows()}
        if self.nodes is not None:
            views |= {"nodes": self.nodes, "edges": graph.flat_edges(self.edges, self.nodes)}
        for name, df in views.items():
            df.createOrReplaceTempView(f"{prefix}_{name}")
        return sorted(f"{prefix}_{n}" for n in views)

    def status(self) -> DataFrame:
        return upkeep.source_status(self.chunks) if "updated_at" in self.chunks.columns else self.source_rows()
