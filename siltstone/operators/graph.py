"""A symbol graph as two tables: upkeep, resolution across files, structural queries.

nodes: id, label, kind (file, function, class, external), subkind, file, start_line, end_line, lang_key.
edges: source, target, relation (contains, calls, inherits, imports, imports_from), confidence, module, base_kind, from_file,
from_line; one row for each ordered pair.

Symbols that are asked for come as a table symbols(symbol); one symbol is a table of one row, see asked().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx

from .lineage import checkpointed

NODE = ["id", "label", "kind", "subkind", "file", "start_line", "end_line", "lang_key"]
EDGE = ["source", "target", "relation", "confidence", "module", "base_kind", "from_file", "from_line"]
NOT_SYMBOLS = ("file", "external")
# Kinds of nodes that are definitions.
DEFINITIONS = ("function", "class", "method", "interface", "struct", "enum", "trait", "module", "type", "constant")
#: Candidates of a name that meet its references in one task.
PIECE = 1_000
#: Nodes of changed names that go to every task at most.
HIT_ROWS = 500_000
#: Different names whose numbers of candidates go to every task at most.
NAMES = 50_000
#: Symbols asked for that go to every task at most.
ASKED_SYMBOLS = 10_000


def asked(spark: SparkSession, *symbols: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


# ---- upkeep ---------------------------------------------------------------------------------------------------------

def upsert_nodes(rows: DataFrame) -> DataFrame:
    """rows: nodes with ord, the order of writing; the last writer of an id wins."""
    rest = [c for c in NODE if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("last")).select("id", *[F.col(f"last.{c}").alias(c) for c in rest])


def upsert_edges(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs): rows of a pair merged attribute by attribute, the last value that isn't null winning; stubs are external nodes for unknown targets."""
    rest = [c for c in EDGE if c not in ("source", "target")]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in rest]
    edges = rows.groupBy("source", "target").agg(*latest)
    unknown = rows.groupBy("target").agg(F.max_by(F.coalesce("module", "target"), "ord").alias("label")).withColumnRenamed("target", "id").join(nodes, "id", "left_anti")
    text = lambda x: F.lit(x).cast("string")
    stubs = unknown.select("id", "label", text("external").alias("kind"), text("external").alias("subkind"), text("").alias("file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), text("").alias("lang_key"))
    return edges, stubs


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(leaf, node_id): functions and classes by the last part of their label, in lower case."""
    return nodes.where(F.col("kind").isin("function", "class")).select(F.lower(tx.leaf(F.col("label"))).alias("leaf"), F.col("id").alias("node_id"))


def _few(names: DataFrame) -> DataFrame:
    """names, one row each, to every task up to NAMES, counted; they are checkpointed."""
    names = checkpointed(names)
    return F.broadcast(names) if names.limit(NAMES + 1).count() <= NAMES else names.hint("merge")


def references(raw: DataFrame, index: DataFrame, name: str, origin: str, member: str | None = None) -> DataFrame:
    """(source, leaf, first, candidates) of raw(origin, name, file, line[, base_kind][, member]): a row for each origin and name that the index has.

    first is the least (file, line, base_kind); member calls of names with several candidates count for nothing.
    """
    base = F.col("base_kind") if "base_kind" in raw.columns else F.lit(None).cast("string")
    place = F.struct(F.col("file").alias("from_file"), F.col("line").alias("from_line"), base.alias("base_kind"))
    firsts = [F.min(place).alias("first"), F.min(F.when(~F.col(member), place)).alias("plain")] if member else [F.min(place).alias("first"), F.min(place).alias("plain")]
    each = raw.groupBy(F.col(origin).alias("source"), F.lower(F.col(name)).alias("leaf")).agg(*firsts)
    sized = each.join(_few(index.groupBy("leaf").agg(F.count("*").alias("candidates"))), "leaf")
    return sized.select("source", "leaf", F.when(F.col("candidates") == 1, F.col("first")).otherwise(F.col("plain")).alias("first"), "candidates").where("first is not null")


def _repeated(index: DataFrame) -> bool:
    return not index.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _matched(raw: DataFrame, index: DataFrame, existing: DataFrame, name: str, origin: str, member: str | None = None, called: DataFrame | None = None) -> DataFrame:
    """references with taken, the candidates that a pair exists with already, fixed, those of them whose pair isn't loose, and called, if the reference is one of those. existing(source, target[, loose])."""
    loose = F.col("loose") if "loose" in existing.columns else F.lit(False)
    pairs = existing.select("source", F.col("target").alias("node_id"), loose.alias("loose"))
    taken = pairs.hint("merge").join(index, "node_id").groupBy("source", "leaf").agg(F.collect_set("node_id").alias("taken"), F.collect_set(F.when(~F.col("loose"), F.col("node_id"))).alias("fixed"))
    refs = references(raw, index, name, origin, member).join(taken.hint("merge"), ["source", "leaf"], "left")
    if called is None:
        return refs.withColumn("called", F.lit(None).cast("boolean"))
    return refs.join(called.select("source", "leaf", F.lit(True).alias("called")).hint("merge"), ["source", "leaf"], "left")


def resolve(raw: DataFrame, index: DataFrame, existing: DataFrame, relation: str, name: str, origin: str, member: str | None = None, self_loops: bool = False, called: DataFrame | None = None) -> DataFrame:
    """Edges for references by name: raw(origin, name, file, line[, base_kind][, member]).

    One candidate gives a resolved edge, several an ambiguous edge each, except that a member call with several gives none.
    Edges to itself (unless self_loops) and pairs that exist already are left out; of references for one pair the first stays.
    called: references whose edges to other nodes exist already too.

    References are first made one row for each origin and name, and pairs that exist are held beside them, so what meets the candidates is
    final: the pairs, as many as references times candidates, are never exchanged. Only if a node has several rows in the index are they.
    """
    repeated = _repeated(index)
    if repeated and called is not None:
        existing = existing.select("source", "target").unionByName(called.join(index, "leaf").where("source <> node_id").select("source", F.col("node_id").alias("target")))
        called = None
    refs = _matched(raw, index, existing, name, origin, member, called)
    free = F.col("taken").isNull() | ~F.array_contains("taken", F.col("node_id"))
    if called is not None:
        free = free & (F.col("called").isNull() | (F.col("source") == F.col("node_id")))
    if not self_loops:
        free = free & (F.col("source") != F.col("node_id"))
    # a name's candidates are dealt to pieces; numbers of partitions are given, as Spark knows the references' size, not the pairs'
    n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.ceil(F.col("candidates") / PIECE).cast("int")
    asked = refs.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).repartition(n, "leaf", "piece")
    sized = index.distinct().join(index.groupBy("leaf").agg(F.count("*").alias("candidates")), "leaf")
    dealt = sized.select("leaf", "node_id", F.pmod(F.xxhash64("node_id"), pieces).cast("int").alias("piece")).repartition(n, "leaf", "piece")
    found = asked.hint("merge").join(dealt, ["leaf", "piece"]).where(free)
    rows = found.select("source", F.col("node_id").alias("target"), F.lit(relation).alias("relation"), F.when(F.col("candidates") == 1, "resolved").otherwise("ambiguous").alias("confidence"), F.lit(None).cast("string").alias("module"), "first.base_kind", "first.from_file", "first.from_line")
    if not repeated:
        return rows
    first = rows.groupBy("source", "target").agg(F.min(F.struct("from_file", "from_line", "confidence", "base_kind")).alias("e"))
    return first.select("source", "target", F.lit(relation).alias("relation"), "e.confidence", F.lit(None).cast("string").alias("module"), "e.base_kind", "e.from_file", "e.from_line")


def resolve_all(nodes: DataFrame, edges: DataFrame, raw_calls: DataFrame, raw_inherits: DataFrame) -> DataFrame:
    """edges with those that calls and then inheritances across files resolve to."""
    return edges.select(*EDGE).unionByName(_resolved(nodes, edges, raw_calls, raw_inherits))


def _resolved(nodes: DataFrame, edges: DataFrame, raw_calls: DataFrame, raw_inherits: DataFrame) -> DataFrame:
    """What resolve_all adds. The pairs of calls stand in the way of inheritances by origin and name, without being made."""
    index = symbol_index(nodes)
    calls = resolve(raw_calls, index, edges, "calls", "callee_name", "caller", "is_member").select(*EDGE)
    called = references(raw_calls, index, "callee_name", "caller", "is_member")
    return calls.unionByName(resolve(raw_inherits, index, edges, "inherits", "base_name", "child", self_loops=True, called=called).select(*EDGE))


def _counted(refs: DataFrame, index: DataFrame, relation: str, self_loops: bool) -> DataFrame:
    """(relation, leaf, confidence, n, again): the edges that _matched references give, by name, and those that they give once loose edges are cleared, for an index without repeated nodes.

    A reference's edges are its candidates without those that a pair exists with and, unless self_loops, its own node.
    """
    own = index.select(F.col("node_id").alias("source"), "leaf", F.lit(1).alias("own")).hint("merge")
    met = refs.join(own, ["source", "leaf"], "left")

    def edges_of(taken: str) -> Column:
        itself = F.when(F.col("own").isNotNull() & ~F.coalesce(F.array_contains(taken, F.col("source")), F.lit(False)), 1).otherwise(0)
        free = F.col("candidates") - F.coalesce(F.array_size(taken), F.lit(0))
        if self_loops:
            return F.when(F.col("called"), itself).otherwise(free).cast("long")
        return F.when(F.col("source").isNull() | F.col("called"), 0).otherwise(free - itself).cast("long")

    each = met.select("leaf", F.when(F.col("candidates") == 1, "resolved").otherwise("ambiguous").alias("confidence"), edges_of("taken").alias("n"), edges_of("fixed").alias("again"))
    return each.groupBy(F.lit(relation).alias("relation"), "leaf", "confidence").agg(F.sum("n").alias("n"), F.sum("again").alias("again"))


def reresolved_counts(nodes: DataFrame, edges: DataFrame, raw_calls: DataFrame, raw_inherits: DataFrame, names: DataFrame) -> DataFrame:
    """(relation, confidence, n): the edges of reresolve after resolve_all, counted.

    What is kept, cleared and resolved again are references, each with its number of edges: the pairs, references times candidates, are
    not made. Only if a node has several rows in the index, so that two names can give one pair, are they.
    """
    index = symbol_index(nodes)
    if _repeated(index):
        again = reresolve(nodes, resolve_all(nodes, edges, raw_calls, raw_inherits), raw_calls, raw_inherits, names)
        return again.groupBy("relation", "confidence").agg(F.count("*").alias("n"))
    names = _few(names.select(F.lower("leaf").alias("leaf")).where("leaf is not null").distinct())
    existing = edges.select("source", "target", _loose().alias("loose"))
    calls = _counted(_matched(raw_calls, index, existing, "callee_name", "caller", "is_member"), index, "calls", False)
    called = references(raw_calls, index, "callee_name", "caller", "is_member")
    bases = _counted(_matched(raw_inherits, index, existing, "base_name", "child", called=called), index, "inherits", True)
    # a row a name
    found = calls.unionByName(bases).join(names.withColumn("changed", F.lit(True)), "leaf", "left")
    told = found.select("relation", "confidence", F.when(F.col("changed"), F.col("again")).otherwise(F.col("n")).alias("n")).where("n > 0")
    plain = clear_resolved(edges, nodes, names).groupBy("relation", "confidence").agg(F.count("*").alias("n"))
    return plain.unionByName(told).groupBy("relation", "confidence").agg(F.sum("n").alias("n"))


def _loose() -> Column:
    return F.col("relation").isin("calls", "inherits") & F.coalesce("confidence", F.lit("")).isin("resolved", "ambiguous")


def clear_resolved(edges: DataFrame, nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """edges without resolved and ambiguous calls and inheritances; with names(leaf) only those whose target has one of these leaves. Extracted edges stay."""
    loose = _loose()
    if names is None:
        return edges.where(~loose)
    hit = checkpointed(symbol_index(nodes).join(names.select(F.lower("leaf").alias("leaf")).distinct(), "leaf", "left_semi").select(F.col("node_id").alias("target")).distinct())
    few = hit.limit(HIT_ROWS + 1).count() <= HIT_ROWS
    kept = edges.where(loose).join(F.broadcast(hit) if few else hit, "target", "left_anti")  # counted
    return edges.where(~loose).unionByName(kept.select(*edges.columns))


def reresolve(nodes: DataFrame, edges: DataFrame, raw_calls: DataFrame, raw_inherits: DataFrame, names: DataFrame) -> DataFrame:
    """The edges after the symbols with these names(leaf) changed: clears and resolves only what refers to them. Equals a full resolution."""
    names = names.select(F.lower("leaf").alias("leaf")).distinct()
    kept = clear_resolved(edges, nodes, names)
    calls = raw_calls.join(names, F.lower("callee_name") == F.col("leaf"), "left_semi")
    bases = raw_inherits.join(names, F.lower("base_name") == F.col("leaf"), "left_semi")
    # of the resolved edges that stay none has a target with these names, so none is a pair that can come again
    return kept.select(*EDGE).unionByName(_resolved(nodes, edges.where(~_loose()), calls, bases))


# ---- lookups --------------------------------------------------------------------------------------------------------

def find_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, node_id): nodes whose label or its leaf is the symbol, case aside; where there is none, those whose label contains it. Files and externals are no symbols.

    Symbols go to all tasks up to ASKED_SYMBOLS, counted; the nodes, whose size Spark doesn't know, never do.
    """
    pool = nodes.where(~F.col("kind").isin(*NOT_SYMBOLS)).select(F.col("id").alias("node_id"), F.lower("label").alias("low"), F.lower(tx.leaf(F.col("label"))).alias("leaf"))
    needles = symbols.select("symbol", F.lower(F.trim("symbol")).alias("needle")).where("needle <> ''").distinct()
    needles = checkpointed(needles)
    few = needles.limit(ASKED_SYMBOLS + 1).count() <= ASKED_SYMBOLS
    keys = pool.select("node_id", F.explode(F.array_distinct(F.array("low", "leaf"))).alias("needle"))
    exact = keys.join(F.broadcast(needles) if few else needles.hint("merge"), "needle").select("symbol", "node_id")
    rest = checkpointed(needles.join(exact.select("symbol").distinct().hint("merge"), "symbol", "left_anti"))
    if rest.isEmpty():
        return exact
    fuzzy = pool.join(F.broadcast(rest) if few else rest.hint("shuffle_replicate_nl"), F.contains(F.col("low"), F.col("needle"))).select("symbol", "node_id")
    return exact.unionByName(fuzzy)


def flat_edges(edges: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """Edges with both ends' columns beside them, in the row format of the interface; missing values become empty strings and zeros.

    The ends come by merges: Spark takes derived nodes for smaller than they are, and would send them all through the driver.
    """
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_symbol"), F.col("kind").alias(f"{side}_kind"), F.col("file").alias(f"{side}_file"), F.col("start_line").alias(f"{side}_start_line"), F.col("end_line").alias(f"{side}_end_line"))
    both = edges.withColumnsRenamed({"source": "from", "target": "to", "from_file": "call_site_file", "from_line": "call_site_line"}).join(end("from").hint("merge"), "from").join(end("to").hint("merge"), "to")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    ends = [f(f"{s}_{c}") for s in ("from", "to") for c, f in (("symbol", text), ("kind", text), ("file", text), ("start_line", number), ("end_line", number))]
    return both.select(*more, text("relation"), text("base_kind"), text("confidence"), text("module"), *ends, text("call_site_file"), number("call_site_line"))


def limited(rows: DataFrame, limit: int | None, by: str = "symbol") -> DataFrame:
    """The first limit rows of each symbol in a fixed order: by the ends' labels, then their files and lines."""
    if limit is None:
        return rows
    order = [F.col(c) for c in ("from_symbol", "to_symbol", "from_file", "to_file", "from_start_line", "to_start_line", "relation")]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= limit).drop("nth")


def incident(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, relations: tuple[str, ...], side: str, limit: int | None = 50) -> DataFrame:
    """Edges of these relations whose source or target (side) is one of the symbols, flat, with symbol. Nodes of one label, file and lines look the same, so rows that do are one."""
    seeds = find_symbols(nodes, symbols)
    hit = edges.where(F.col("relation").isin(*relations)).join(seeds.withColumnRenamed("node_id", side), side).select("symbol", *EDGE)
    return limited(flat_edges(hit, nodes, "symbol").distinct(), limit)


def callers(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int | None = 50) -> DataFrame:
    return incident(nodes, edges, symbols, ("calls",), "target", limit)


def callees(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int | None = 50) -> DataFrame:
    return incident(nodes, edges, symbols, ("calls",), "source", limit)


def subclasses(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int | None = 50) -> DataFrame:
    return incident(nodes, edges, symbols, ("inherits",), "target", limit)


def superclasses(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int | None = 50) -> DataFrame:
    return incident(nodes, edges, symbols, ("inherits",), "source", limit)


def nodes_in_file(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(asked, node columns): definitions in files whose path contains the asked piece, case and slashes aside."""
    needles = files.select("asked", F.lower(tx.slashes(F.col("asked"))).alias("needle")).where("trim(needle) <> ''")
    return nodes.where(F.col("kind").isin(*DEFINITIONS)).join(needles, F.contains(F.lower(tx.slashes(F.col("file"))), F.col("needle"))).select("asked", *NODE)


def imports(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int | None = 100) -> DataFrame:
    """Import edges of the file of a symbol, or, where there is no such symbol, of files whose path or name contains it."""
    seeds = find_symbols(nodes, symbols)
    files = nodes.where("kind = 'file'").select(F.col("id").alias("source"), F.col("file").alias("path"), "label")
    by_symbol = seeds.join(nodes.select(F.col("id").alias("node_id"), F.col("file").alias("path")), "node_id").join(files, "path").select("symbol", "source").distinct()
    rest = symbols.join(by_symbol.select("symbol").distinct(), "symbol", "left_anti").withColumn("needle", F.lower(tx.slashes(F.trim("symbol")))).where("needle <> ''")
    by_path = files.join(rest, F.contains(F.lower(tx.slashes(F.concat_ws(" ", "path", "label"))), F.col("needle"))).select("symbol", "source").distinct()
    hit = edges.where(F.col("relation").isin("imports", "imports_from")).join(by_symbol.unionByName(by_path), "source").select("symbol", *EDGE)
    return limited(flat_edges(hit, nodes, "symbol").distinct(), limit)


# ---- walks ----------------------------------------------------------------------------------------------------------

def clamp(depth: int, low: int = 1, high: int = 6) -> int:
    return max(low, min(int(depth), high))


def reach(seeds: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(symbol, node_id, depth): all within depth steps(here, there) of seeds(symbol, node_id), at their least depth; seeds have 0.

    Level by level: a level holds the nodes that no earlier one has, so cycles and many walks to a node cost nothing extra.
    Each level is cut from its lineage, and the walk ends with the first empty one.
    """
    level = checkpointed(seeds.select("symbol", "node_id").distinct().withColumn("depth", F.lit(0)))
    steps = checkpointed(steps) if depth > 1 else steps  # what makes them runs once, not at each level
    out = level
    for d in range(1, depth + 1):
        new = level.join(steps, level.node_id == steps.here).select("symbol", F.col("there").alias("node_id")).distinct()
        level = checkpointed(new.join(out.select("symbol", "node_id"), ["symbol", "node_id"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def transitive_callers(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, max_depth: int = 3, limit: int | None = None) -> DataFrame:
    """(symbol, id, label, file, depth) of all that call a symbol over up to max_depth calls; the symbol itself isn't among them."""
    steps = edges.where("relation = 'calls'").select(F.col("target").alias("here"), F.col("source").alias("there"))
    found = reach(find_symbols(nodes, symbols), steps, clamp(max_depth)).where("depth > 0")
    rows = found.join(nodes.withColumnRenamed("id", "node_id"), "node_id").select("symbol", F.col("node_id").alias("id"), "label", "file", "depth")
    if limit is None:
        return rows
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "label", "id"))).where(F.col("nth") <= limit).drop("nth")


def descendants(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, levels: int = 6) -> DataFrame:
    """(symbol, id, label, level) of all classes below the symbols' classes by inheritance."""
    steps = edges.where("relation = 'inherits'").select(F.col("target").alias("here"), F.col("source").alias("there"))
    found = reach(find_symbols(nodes, symbols), steps, levels).where("depth > 0")
    return found.join(nodes.withColumnRenamed("id", "node_id"), "node_id").select("symbol", F.col("node_id").alias("id"), "label", F.col("depth").alias("level"))


def neighbors(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 1, relation: str | None = None) -> DataFrame:
    """Edges met within depth steps of the symbols in either direction, flat; a relation limits what is shown, not where the walk goes."""
    depth = clamp(depth)
    both = edges.select(F.col("source").alias("here"), F.col("target").alias("there")).unionByName(edges.select(F.col("target").alias("here"), F.col("source").alias("there"))).distinct()
    inner = reach(find_symbols(nodes, symbols), both, depth - 1).select("symbol", "node_id")
    shown = edges if relation is None else edges.where(F.col("relation") == relation)
    hit = shown.join(inner.withColumnRenamed("node_id", "source"), "source").select("symbol", *EDGE)
    hit = hit.unionByName(shown.join(inner.withColumnRenamed("node_id", "target"), "target").select("symbol", *EDGE)).distinct()
    return flat_edges(hit, nodes, "symbol")


def shortest_path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_hops: int = 8) -> DataFrame:
    """(source_symbol, target_symbol, hops, path): the shortest directed way over all relations between any of their nodes, up to max_hops; of equals the first path in order of ids.

    A node has one row: the least path of the first level that reaches it, from which all shortest paths over it go on.
    """
    pairs = pairs.select("source_symbol", "target_symbol").distinct()
    starts = find_symbols(nodes, pairs.select(F.col("source_symbol").alias("symbol"))).withColumnsRenamed({"symbol": "source_symbol"})
    goals = find_symbols(nodes, pairs.select(F.col("target_symbol").alias("symbol"))).withColumnsRenamed({"symbol": "target_symbol"})
    level = starts.select("source_symbol", "node_id", F.array("node_id").alias("path"))
    out = level
    steps = checkpointed(edges.select(F.col("source").alias("here"), F.col("target").alias("there")))
    for _ in range(max_hops):
        new = level.join(steps, level.node_id == steps.here).groupBy("source_symbol", F.col("there").alias("node_id")).agg(F.min(F.concat("path", F.array("there"))).alias("path"))
        level = checkpointed(new.join(out.select("source_symbol", "node_id"), ["source_symbol", "node_id"], "left_anti"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    found = pairs.join(out, "source_symbol").join(goals, ["target_symbol", "node_id"])
    best = found.groupBy("source_symbol", "target_symbol").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("best"))
    return best.select("source_symbol", "target_symbol", (F.col("best.n") - 1).cast("long").alias("hops"), F.array_join("best.path", ">").alias("path"))


def symbol_view(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """(symbol, id, label, layer, role): seeds at layer 0, callers at negative, callees at positive layers; a node on both sides goes to the nearer one, callers first."""
    seeds = find_symbols(nodes, symbols)
    calls = checkpointed(edges.where("relation = 'calls'").select("source", "target"))
    up = reach(seeds, calls.select(F.col("target").alias("here"), F.col("source").alias("there")), clamp(depth)).withColumn("layer", -F.col("depth"))
    down = reach(seeds, calls.select(F.col("source").alias("here"), F.col("target").alias("there")), clamp(depth)).withColumn("layer", F.col("depth"))
    both = up.unionByName(down).groupBy("symbol", "node_id").agg(F.min(F.struct("depth", "layer")).alias("near"))
    role = F.when(F.col("layer") == 0, "seed").when(F.col("layer") < 0, "caller").otherwise("callee")
    rows = both.select("symbol", "node_id", F.col("near.layer").alias("layer")).join(nodes.withColumnRenamed("id", "node_id"), "node_id")
    return rows.select("symbol", F.col("node_id").alias("id"), "label", "layer", role.alias("role"))


def module_summary(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(asked, n_symbols, n_imports, dependents): what is in the files, what they import, and the other files that call into them, sorted."""
    inside = nodes_in_file(nodes, files)
    needles = files.withColumn("needle", F.lower(tx.slashes(F.col("asked")))).where("trim(needle) <> ''")
    own = nodes.where("kind = 'file'").join(needles, F.contains(F.lower(tx.slashes(F.col("file"))), F.col("needle"))).select("asked", F.col("id").alias("source"))
    taken = edges.where(F.col("relation").isin("imports", "imports_from")).join(own, "source").groupBy("asked").agg(F.count("*").alias("n_imports"))
    place = nodes.select(F.col("id").alias("source"), F.col("file").alias("from"))
    users = edges.where("relation = 'calls'").join(inside.select("asked", F.col("id").alias("target"), F.col("file").alias("own")), "target").join(place, "source").where("from <> own")
    users = users.groupBy("asked").agg(F.array_join(F.array_sort(F.collect_set("from")), ",").alias("dependents"))
    count = inside.groupBy("asked").agg(F.count("*").alias("n_symbols"))
    rows = files.join(count, "asked", "left").join(taken, "asked", "left").join(users, "asked", "left")
    return rows.select("asked", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_imports", F.lit(0)).alias("n_imports"), F.coalesce("dependents", F.lit("")).alias("dependents"))


def module_view(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(asked, id, label, layer, role): a module's symbols at layer 0, what its files import at -1, callers from other files at 1."""
    inside = nodes_in_file(nodes, files)
    needles = files.withColumn("needle", F.lower(tx.slashes(F.col("asked")))).where("trim(needle) <> ''")
    own = nodes.where("kind = 'file'").join(needles, F.contains(F.lower(tx.slashes(F.col("file"))), F.col("needle"))).select("asked", F.col("id").alias("source"))
    row = lambda df, layer, role: df.select("asked", "id", F.lit(layer).alias("layer"), F.lit(role).alias("role")).distinct()
    seeds = row(inside, 0, "seed")
    taken = row(edges.where(F.col("relation").isin("imports", "imports_from")).join(own, "source").withColumnRenamed("target", "id"), -1, "import")
    place = nodes.select(F.col("id").alias("source"), F.col("file").alias("from"))
    users = edges.where("relation = 'calls'").join(inside.select("asked", F.col("id").alias("target"), F.col("file").alias("own")), "target").join(place, "source").where("from <> own").withColumnRenamed("source", "id")
    every = seeds.unionByName(taken).unionByName(row(users, 1, "dependent"))
    first = every.groupBy("asked", "id").agg(F.min(F.struct(F.abs("layer").alias("far"), "layer", "role")).alias("best"))
    return first.join(nodes.select("id", "label"), "id").select("asked", "id", "label", "best.layer", "best.role")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dimension, value, n): nodes by language (external if none) and by kind, edges by relation."""
    lang = F.when(F.coalesce("lang_key", F.lit("")) == "", "external").otherwise(F.col("lang_key"))
    by = nodes.select(lang.alias("language"), "kind").groupingSets([["language"], ["kind"]], "language", "kind").agg(F.count("*").alias("n"))
    side = by.select(F.when(F.col("language").isNotNull(), "language").otherwise("kind").alias("dimension"), F.coalesce("language", "kind").alias("value"), "n")
    return side.unionByName(edges.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("relation").alias("dimension"), F.col("relation").alias("value"), "n"))


def pr_impact(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, caller, caller_file): for changed(path, content) the symbols that it declares, and who calls them from other files."""
    names = changed.select("path", F.explode(tx.declared_symbols(F.col("content"))).alias("symbol"))
    seeds = find_symbols(nodes, names.select("symbol").distinct())
    place = nodes.select(F.col("id").alias("source"), F.col("label").alias("caller"), F.col("file").alias("caller_file"))
    hit = edges.where("relation = 'calls'").join(seeds.withColumnRenamed("node_id", "target"), "target").join(place, "source").join(names, "symbol")
    return hit.where(F.col("caller_file") != F.col("path")).select("symbol", "caller", "caller_file").distinct()
