"""Graph analytics: hubs, communities, bridges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import NOT_SYMBOLS
from .lineage import checkpointed

#: Nodes up to which betweenness takes every node as a source; beyond, SAMPLE sources.
EXACT_NODES, SAMPLE = 1_500, 200
#: Edges up to which every task holds the adjacency of the whole graph and gives out credits as rows, and up to which it gives them out as blocks of numbers; beyond, walks are joins. The result is the same.
LOCAL_EDGES, BLOCK_EDGES = 8_000_000, 24_000_000
#: Edges that a walk expands at a time, and credits in a block.
STEP, CREDITS = 2_000_000, 500_000
#: Pairs of a component up to which a task agglomerates it; the groups of a larger one are merged block by block until no more than these are left between them.
LOCAL_PAIRS = 400_000
#: Rows of a round's merges that go to every task, and so through the driver, at most.
MERGES = 50_000


def hubs(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """The top_n symbols by the number of edges at either end, then by id; rank from 1."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    degree = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    rows = nodes.where(~F.col("kind").isin(*NOT_SYMBOLS)).join(degree, "id", "left").select("id", "label", "kind", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    rows = rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    best = rows.orderBy(F.col("degree").desc(), "id").limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("degree").desc(), "id")))  # top_n rows


def symbol_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b), a < b: symbols with an edge between them in either direction."""
    ids = nodes.where(~F.col("kind").isin(*NOT_SYMBOLS)).select("id")
    both = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return both.join(ids.withColumnRenamed("id", "a").hint("merge"), "a", "left_semi").join(ids.withColumnRenamed("id", "b").hint("merge"), "b", "left_semi")


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the least id that can be reached. Least labels spread along edges and then jump to their label's label; a round's labels are checkpointed.

    Joins are merges: Spark takes derived rows for fewer than they are, and would send them all through the driver.
    """
    both = checkpointed(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "c").hint("merge"), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = labels.join(near.hint("merge"), labels.id == near.a).select("id", F.least("c", "m").alias("n"), "c")
        jump = low.select(F.col("id").alias("n"), F.col("n").alias("further"))
        new = checkpointed(low.join(jump.hint("merge"), "n").select("id", F.least("n", "further").alias("n"), "c"))
        changed = new.where("n <> c").limit(1).count()
        labels = new.select("id", F.col("n").alias("c"))
        if not changed:
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError("components: labels still change")


def modularity_groups(pairs: list[tuple[str, str]], weights: list[int] | None = None, degrees: dict[str, int] | None = None, m: int | None = None, until: int = 1) -> dict[str, int]:
    """Greedy agglomeration by modularity gain; equal gains take the least pair, so reruns agree.

    Gains are whole numbers, times 2 * m ** 2, in a heap. The group with fewer neighbours goes into the other one, and
    only its pairs are entered anew; what its partner gains with others only falls, so those entries are put right when
    they come up. Where pairs are of groups already, weights are the pairs between two, degrees those at each and m all of them.
    Merging ends when until groups are left, or none gains.
    """
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    m = len(pairs) if m is None else m
    degree = [0] * len(ids) if degrees is None else [degrees[x] for x in ids]
    between: list[dict[int, int]] = [{} for _ in ids]
    for n, (a, b) in enumerate(pairs):
        i, j = at[a], at[b]
        between[i][j] = between[j][i] = between[i].get(j, 0) + (1 if weights is None else weights[n])
        if degrees is None:
            degree[i] += 1
            degree[j] += 1
    least, members = list(range(len(ids))), [[i] for i in range(len(ids))]

    def entry(x: int, y: int) -> tuple[int, int, int, int, int]:
        if least[y] < least[x]:
            x, y = y, x
        return degree[x] * degree[y] - 2 * m * between[x][y], least[x], least[y], x, y

    heap = [e for x in range(len(ids)) for y in between[x] if y > x and (e := entry(x, y))[0] < 0]
    heapify(heap)
    left = len(ids)
    while heap and left > until:
        old = heappop(heap)
        x, y = old[3:]
        if y not in between[x]:
            continue
        now = entry(x, y)
        if now != old:
            if old < now and now[0] < 0:
                heappush(heap, now)
            continue
        if len(between[x]) < len(between[y]):
            x, y = y, x
        theirs, between[y] = between[y], {}
        degree[x] += degree[y]
        least[x] = min(least[x], least[y])
        members[x] += members[y]
        left -= 1
        for k, w in theirs.items():
            del between[k][y]
            if k != x:
                between[x][k] = between[k][x] = between[x].get(k, 0) + w
        for k in theirs:
            if k != x and (e := entry(x, k))[0] < 0:
                heappush(heap, e)
        members[y] = []
    return {ids[k]: least[x] for x, group in enumerate(members) for k in group}


def _communities(frame: pd.DataFrame) -> pd.DataFrame:
    degrees = dict(zip(frame["a"], frame["da"].tolist())) | dict(zip(frame["b"], frame["db"].tolist()))
    groups = modularity_groups(list(zip(frame["a"], frame["b"])), frame["w"].tolist(), degrees, int(frame["m"].iloc[0]))
    least: dict[int, str] = {}
    for node, g in groups.items():
        least[g] = min(least.get(g, node), node)
    return pd.DataFrame({"id": list(groups), "community": [least[g] for g in groups.values()]})


def _halved(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of a block to (id, into, d): its groups merged, best gain first, until half as many are left; into is the least of a merged group, d its degree."""
    degrees = dict(zip(frame["a"], frame["da"].tolist())) | dict(zip(frame["b"], frame["db"].tolist()))
    groups = modularity_groups(list(zip(frame["a"], frame["b"])), frame["w"].tolist(), degrees, int(frame["m"].iloc[0]), len(degrees) // 2)
    merged: dict[int, list[str]] = {}
    for x, g in groups.items():
        merged.setdefault(g, []).append(x)
    rows = [(x, min(own), d) for own in merged.values() if len(own) > 1 for d in [sum(degrees[x] for x in own)] for x in own]
    return pd.DataFrame(rows, columns=["id", "into", "d"]).astype({"d": "int64"})


def _merges(links: DataFrame, turn: int) -> DataFrame:
    """(id, into, d): groups that become one, into its least, with the degree that comes of it.

    What a merge gains hangs on its two groups alone, so groups are dealt to blocks by the hash of their name and the turn, and each
    block merges on its own. Only links that gain go along, as many to a block as a task takes: links left out only add to a gain.
    """
    gains = checkpointed(links.where("2 * m * w > da * db"))
    blocks = max(1, int(np.ceil(np.sqrt(gains.groupBy("component").count().agg(F.max("count")).first()[0] / LOCAL_PAIRS))))
    while True:
        block = lambda x: F.pmod(F.xxhash64(F.lit(turn), x), F.lit(blocks))
        inside = gains.withColumn("block", block("a")).where(F.col("block") == block("b"))
        if blocks == 1 or not inside.groupBy("component", "block").count().where(F.col("count") > 2 * LOCAL_PAIRS).limit(1).count():
            break
        blocks *= 2  # a group with very many links
    return inside.groupBy("component", "block").applyInPandas(_halved, "id string, into string, d bigint")


def _agglomerated(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of at most LOCAL_PAIRS rows a component, or none that gains, and (id, group) of what went into another group): whole components never meet in a task.

    links are (component, m, a, b, da, db, w); a round's merges gain exactly what each does, or more, and its links are checkpointed.
    """
    members, turn = None, 0
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # as many rows as components of over LOCAL_PAIRS links
        large = links.groupBy("component").agg(F.count("*").alias("n"), F.max((2 * F.col("m") * F.col("w") > F.col("da") * F.col("db")).cast("int")).alias("gains")).where((F.col("n") > LOCAL_PAIRS) & (F.col("gains") == 1)).select("component")
        large = checkpointed(large)
        if not large.limit(1).count():
            return links, members
        merges = checkpointed(_merges(links.join(F.broadcast(large), "component", "left_semi"), turn).repartition(n, "id"))  # the exchange keeps a checkpoint from merging twice
        turn += 1
        few = merges.limit(MERGES + 1).count() <= MERGES
        hint = F.broadcast if few else lambda df: df.hint("merge")  # counted
        for end in "ab":
            own = merges.select(F.col("id").alias(end), F.col("into").alias("to"), F.col("d").alias("new"))
            links = links.join(hint(own), end, "left").withColumns({end: F.coalesce("to", end), f"d{end}": F.coalesce("new", f"d{end}")}).drop("to", "new")
        turned = F.col("a") > F.col("b")
        ends = {x: F.when(turned, F.col(y)).otherwise(F.col(x)) for x, y in (("a", "b"), ("b", "a"), ("da", "db"), ("db", "da"))}
        links = checkpointed(links.where("a <> b").select("component", "m", *[c.alias(x) for x, c in ends.items()], "w").groupBy("component", "m", "a", "b", "da", "db").agg(F.sum("w").alias("w")))
        went = merges.where("id <> into").select("id", "into")
        moved = went.select("id", F.col("into").alias("group"))
        if members is not None:
            moved = moved.unionByName(members.join(hint(went.select(F.col("id").alias("group"), "into")), "group", "left").select("id", F.coalesce("into", "group").alias("group")))
        members = checkpointed(moved)


def communities(nodes: DataFrame, edges: DataFrame, min_size: int = 3) -> DataFrame:
    """(community, name, size, members, languages, rank): groups of symbols by greedy modularity, each component on its own; name is the member of most edges.

    languages counts the members by language key ("?" if they have none), as language:count in order of the language.

    A component of up to LOCAL_PAIRS pairs is agglomerated in a task, merge by merge. A larger one is dealt to blocks whose groups merge
    on their own, each with gain, and dealt anew, until so few pairs are left between its groups; these then go on merge by merge.
    Joins of nodes and pairs are merges, so that none of them goes through the driver.
    """
    pairs = checkpointed(symbol_pairs(nodes, edges))
    parts = components(pairs)
    tagged = checkpointed(pairs.join(parts.withColumnRenamed("id", "a").hint("merge"), "a"))
    degrees = checkpointed(tagged.select("component", F.explode(F.array("a", "b")).alias("id")).groupBy("component", "id").agg(F.count("*").alias("d")))
    sizes = degrees.groupBy("component").agg((F.sum("d") / 2).cast("long").alias("m"))
    known = degrees.join(sizes.hint("merge"), "component").select("id", "d", "m")
    links = tagged.join(known.withColumnsRenamed({"id": "a", "d": "da"}).hint("merge"), "a").join(known.select(F.col("id").alias("b"), F.col("d").alias("db")).hint("merge"), "b").withColumn("w", F.lit(1).cast("long"))
    links, members = _agglomerated(checkpointed(links.select("component", "m", "a", "b", "da", "db", "w")))
    ends = links.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_PAIRS)  # none of these gains; a row for each component of over LOCAL_PAIRS links
    groups = links.join(F.broadcast(ends), "component", "left_anti").groupBy("component").applyInPandas(_communities, "id string, community string")
    if members is not None:
        # a group that merged by joins is named by its key so far, and some are linked to none
        keyed = degrees.select("id").join(members.hint("merge"), "id", "left").select("id", F.coalesce("group", "id").alias("group"))
        named = keyed.join(groups.select(F.col("id").alias("group"), "community").hint("merge"), "group", "left").select("id", F.coalesce("community", "group").alias("key"))
        named = checkpointed(named)
        groups = named.join(named.groupBy("key").agg(F.min("id").alias("community")).hint("merge"), "key").select("id", "community")
    degree = degrees.select("id", F.col("d").alias("degree"))
    lang = F.when(F.coalesce("lang_key", F.lit("")) == "", "?").otherwise(F.col("lang_key"))
    rows = checkpointed(groups).join(nodes.select("id", "label", lang.alias("lang")).hint("merge"), "id").join(degree.hint("merge"), "id")
    by_lang = rows.groupBy("community", "lang").agg(F.count("*").alias("n")).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "lang", "n"))), ",").alias("languages"))
    first = rows.where("label is not null").withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy("label"))).where("nth <= 10").groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("members"))
    out = rows.groupBy("community").agg(F.max_by("label", F.struct("degree", "label")).alias("name"), F.count("*").alias("size"))
    out = out.where(F.col("size") >= min_size).join(first.hint("merge"), "community", "left").select("community", "name", "size", F.coalesce("members", F.lit("")).alias("members")).join(by_lang.hint("merge"), "community")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc(), "community")))  # one row a community


def _brandes(batches: Iterator[pa.RecordBatch], begin: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sources, as numbers, to (a, b, c): what all shortest paths from them credit each edge with. Node i's neighbours are ends[begin[i]:begin[i + 1]]; whole levels are walked at once."""
    n, total = len(begin) - 1, None
    for batch in batches:
        for s in batch.column(0).to_pylist():
            distance, paths = np.full(n, -1, np.int32), np.zeros(n)
            distance[s], paths[s] = 0, 1.0
            levels = [np.array([s])]
            steps = []  # of each level: the edges to the next one, and the nodes that they begin at
            while len(levels[-1]):
                at = levels[-1]
                sizes = begin[at + 1] - begin[at]
                edge = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begin[at], sizes)
                far = ends[edge]
                new = distance[far] < 0
                edge, far, near = edge[new].astype(np.int32), far[new], np.repeat(at, sizes)[new].astype(np.int32)
                distance[far] = len(levels)
                paths += np.bincount(far, paths[near], n)
                steps.append((edge, near))
                levels.append(np.flatnonzero(distance == len(levels)))
            total = np.zeros(len(ends)) if total is None else total
            credit = np.zeros(n)
            for edge, near in reversed(steps):
                far = ends[edge]
                c = paths[near] / paths[far] * (1 + credit[far])
                total[edge] += c
                credit += np.bincount(near, c, n)
    if total is not None:
        edge = np.flatnonzero(total)
        near, far = np.searchsorted(begin, edge, side="right") - 1, ends[edge]
        for i in range(0, len(edge), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, far)[part].astype(np.int64)), pa.array(np.maximum(near, far)[part].astype(np.int64)), pa.array(total[edge[part]])], names=["a", "b", "c"])


def _local_credit(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(a, b, c) of each pair from all sources(id): the adjacency goes to each task, as numbers; names stay in Spark."""
    names = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("i", F.monotonically_increasing_id()))
    rows = pairs.join(names.select(F.col("name").alias("a"), F.col("i").alias("x")), "a").join(names.select(F.col("name").alias("b"), F.col("i").alias("y")), "b").select("x", "y").toArrow()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    del rows
    near, far = np.concatenate([x, y]), np.concatenate([y, x])
    ids, near = np.unique(near, return_inverse=True)
    far = np.searchsorted(ids, far)
    order = np.lexsort((far, near))
    begin, ends = np.searchsorted(near[order], np.arange(len(ids) + 1)), far[order].astype(np.int32)
    del x, y, near, far, order
    spark = pairs.sparkSession
    dense = spark.createDataFrame(pa.table({"i": pa.array(ids, pa.int64()), "n": pa.array(np.arange(len(ids)), pa.int64())}))
    names = checkpointed(names.join(dense, "i").select("n", "name"))
    chosen = sources.join(names, F.col("id") == F.col("name")).select("n")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    credit = chosen.repartition(tasks).mapInArrow(partial(_brandes, begin=begin, ends=ends), "a bigint, b bigint, c double").groupBy("a", "b").agg(F.sum("c").alias("c"))
    # which end of a pair comes first is by name again
    named = credit.join(names.select(F.col("n").alias("a"), F.col("name").alias("name_a")), "a").join(names.select(F.col("n").alias("b"), F.col("name").alias("name_b")), "b")
    return named.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "c")


def _expanded(at: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(edge, near, far) of all edges that begin at these nodes, about STEP at a time."""
    sizes = begin[at + 1] - begin[at]
    cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(sizes), np.arange(STEP, sizes.sum(), STEP)), len(at)])
    for i, j in zip(cuts, cuts[1:]):
        own, size = at[i:j], sizes[i:j]
        edge = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[own], size)
        yield edge, np.repeat(own, size), ends[edge]


def _walked(sources: Iterator[int], begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What _brandes credits each edge with, holding levels of nodes only: edges are expanded anew on the way back."""
    n, total = len(begin) - 1, np.zeros(len(ends))
    for s in sources:
        distance, paths, levels = np.full(n, -1, np.int32), np.zeros(n), [np.array([s])]
        distance[s], paths[s] = 0, 1.0
        while len(levels[-1]):
            d = len(levels)
            for _, near, far in _expanded(levels[-1], begin, ends):
                new = (distance[far] < 0) | (distance[far] == d)
                far, near = far[new], near[new]
                distance[far] = d
                paths += np.bincount(far, paths[near], n)
            levels.append(np.flatnonzero(distance == d))
        credit = np.zeros(n)
        for d in range(len(levels) - 2, 0, -1):
            for edge, near, far in _expanded(levels[d - 1], begin, ends):
                on = distance[far] == d
                edge, near, far = edge[on], near[on], far[on]
                c = paths[near] / paths[far] * (1 + credit[far])
                total[edge] += c
                credit += np.bincount(near, c, n)
    return total


def _credit_blocks(batches: Iterator[pa.RecordBatch], graph) -> Iterator[pa.RecordBatch]:
    """Sources to (block, credits): those of all pairs x < y in the order of the adjacency, both directions added up."""
    sources = [s for batch in batches for s in batch.column(0).to_pylist()]
    if not sources:
        return
    begin, ends = graph.value
    total = _walked(sources, begin, ends)
    total += total[np.argsort(ends, kind="stable")]  # the edges by far end and near end are the other directions, in order
    total = total[np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin)) < ends]
    for i in range(0, len(total), CREDITS):
        yield pa.RecordBatch.from_arrays([pa.array([i // CREDITS]), pa.array([total[i : i + CREDITS].tobytes()], pa.binary())], names=["block", "credits"])


def _best_of_block(rows: pa.Table, graph, top_n: int, scale: float) -> pa.Table:
    """(block, credits) of all tasks to (a, b, c) of the top_n pairs, with all that rounding could put beside them."""
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in rows["credits"])
    least = np.partition(total, -top_n)[-top_n] - 1e-6 / scale if len(total) > top_n else 0.0
    some = np.flatnonzero((total >= least) & (total > 0))
    begin, ends = graph.value
    edge = np.flatnonzero(np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin)) < ends)[rows["block"][0].as_py() * CREDITS + some]
    near = np.searchsorted(begin, edge, side="right") - 1
    return pa.table({"a": pa.array(near.astype(np.int64)), "b": pa.array(ends[edge].astype(np.int64)), "c": pa.array(total[some])})


def _block_credit(pairs: DataFrame, sources: DataFrame, top_n: int, scale: float) -> DataFrame:
    """(a, b, c) of the top_n pairs at least: the adjacency, 4 bytes an edge and direction, is broadcast; tasks give out credits as blocks of numbers, which are added up block by block."""
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("i", F.monotonically_increasing_id()))
    counts = names.groupBy(F.shiftright("i", 33).alias("task")).count().orderBy("task").collect()  # a row a task
    first = spark.createDataFrame([(r.task, sum(x["count"] for x in counts[:k])) for k, r in enumerate(counts)], "task long, first long")
    names = checkpointed(names.join(F.broadcast(first), F.shiftright("i", 33) == F.col("task")).select((F.col("i") - F.shiftleft("task", 33) + F.col("first")).cast("int").alias("n"), "name"))
    end = lambda name, number: names.select(F.col("name").alias(name), F.col("n").alias(number)).hint("merge")
    numbered = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
    rows = numbered.groupBy("x").agg(F.array_sort(F.collect_list("y")).alias("far")).orderBy("x").select("far").toArrow()["far"]
    begin = np.r_[0, np.cumsum(np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in rows.chunks]).astype(np.int64))]
    ends = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.chunks]).astype(np.int32, copy=False)
    del rows
    graph = spark.sparkContext.broadcast((begin, ends))
    del begin, ends
    chosen = sources.join(names.hint("merge"), F.col("id") == F.col("name")).select("n")
    # each task's blocks are exchanged before anything reads them, so walks run once
    blocks = chosen.repartition(tasks).mapInArrow(partial(_credit_blocks, graph=graph), "block bigint, credits binary").repartition(4 * tasks, "block")
    best = checkpointed(blocks.groupBy("block").applyInArrow(lambda rows: _best_of_block(rows, graph, top_n, scale), "a bigint, b bigint, c double").repartition(tasks))
    named = best.join(end("name_a", "a"), "a").join(end("name_b", "b"), "b")
    return named.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "c")


def _joined_credit(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """The same by joins, level by level from all sources at once, then back; a level's rows are checkpointed."""
    both = checkpointed(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w"))))
    levels = [checkpointed(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    while True:
        new = levels[-1].join(both, "v").groupBy("s", "w").agg(F.sum("paths").alias("paths")).withColumnRenamed("w", "v")
        for seen in levels[-2:]:  # a neighbour is one level up, on the same one, or new
            new = new.join(seen.select("s", "v"), ["s", "v"], "left_anti")
        new = checkpointed(new.select("s", "v", "paths"))
        if not new.limit(1).count():
            break
        levels.append(new)
    parts, credit = [], None
    for far, near in zip(levels[:0:-1], levels[-2::-1]):
        own = far.withColumn("credit", F.lit(0.0)) if credit is None else far.join(credit, ["s", "v"], "left").withColumn("credit", F.coalesce("credit", F.lit(0.0)))
        back = own.select("s", "v", F.col("paths").alias("p"), "credit").join(both, "v").join(near.select("s", F.col("v").alias("w"), "paths"), ["s", "w"])
        shares = checkpointed(back.select("s", "v", "w", (F.col("paths") / F.col("p") * (1 + F.col("credit"))).alias("c")))
        credit = shares.groupBy("s", "w").agg(F.sum("c").alias("credit")).withColumnRenamed("w", "v")
        parts.append(shares.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), "c"))
    every = parts[0] if parts else pairs.select("a", "b", F.lit(0.0).alias("c")).limit(0)
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("a", "b").agg(F.sum("c").alias("c"))


def bridges(nodes: DataFrame, edges: DataFrame, top_n: int = 5) -> DataFrame:
    """The top_n edges by betweenness, undirected, over symbols: a, b, score (normalised, 6 digits), rank.

    Over EXACT_NODES nodes, SAMPLE sources by the hash of their id stand for all. Up to BLOCK_EDGES edges, counted, sources are
    spread over tasks that hold the adjacency; beyond, all walks go on together by joins.
    """
    pairs = checkpointed(symbol_pairs(nodes, edges))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    n = ids.count()
    sources = checkpointed(ids if n <= EXACT_NODES else ids.orderBy(F.md5("id"), "id").limit(SAMPLE))
    scale = (n / min(n, SAMPLE if n > EXACT_NODES else n)) / (n * (n - 1)) if n > 1 else 0.0
    size = pairs.count()
    if LOCAL_EDGES < size <= BLOCK_EDGES:
        credit = _block_credit(pairs, sources, top_n, scale)
    else:
        credit = (_local_credit if size <= LOCAL_EDGES else _joined_credit)(pairs, sources)
    best = credit.select("a", "b", F.round(F.col("c") * scale, 6).alias("score")).orderBy(F.col("score").desc(), "a", "b").limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "a", "b")))  # top_n rows
