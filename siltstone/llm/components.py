"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

#: Edges up to which a round's minima, two longs each, are broadcast.
SMALL = 500_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """edges(src, dst), longs; (node, root) for every node that has an edge to another, root the smallest node reachable.

    Large-star hangs a node's greater neighbours on its smallest neighbour, small-star its smaller ones; minima are taken
    with partial aggregation before each exchange. A round's edges are a table of the shared folder, removed a round later.
    Up to small edges, the minima go to all tasks; beyond, they are tables too, and a join splits a node with very many edges.
    When a round changes nothing the edges are stars. Null ends, loops and repeated edges are left out; no edges give no rows.
    """
    edges = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = durable(edges)
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        whole = mark[0] > small
        # Minima have no more rows than edges, which are counted; from small on they are tables, and a join can split a node with very many edges.
        held = durable if whole else F.broadcast
        # Only nodes with a smaller neighbour have a row in low; for others the large star leaves their edges as they are.
        low = held(edges.groupBy("src").agg(F.min("dst").alias("low")))
        large = edges.join(low.withColumnRenamed("src", "dst"), "dst", "left").select("src", F.coalesce("low", "dst").alias("dst")).distinct()
        large = durable(large) if whole else large
        least = held(large.groupBy("src").agg(F.min("dst").alias("low")))
        lower = large.join(least, "src").where("dst <> low").select(F.greatest("dst", "low").alias("src"), F.least("dst", "low").alias("dst"))
        done = (edges, low, large, least) if whole else (edges,)
        edges = durable(lower.unionByName(least.select("src", F.col("low").alias("dst"))).distinct())
        for table in done:
            discard(table)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    roots = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
