"""Exact top-k by inner product from a pivot-distance index: vectors keyed by nearest pivot and distance, read annulus by annulus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable

SCALE = 1024
#: Vectors that the pivots are chosen among, those with the least hashes of their identifiers.
FIT_ROWS = 4_096
#: Pivots and annuli of one pivot at most: their product bounds the directory that tasks hold.
MAX_PIVOTS, MAX_RINGS = 256, 64
#: Components of a block of the index; rows of a block are this over the vectors' width.
BLOCK_VALUES = 65_536
#: Queries that share a tile, about.
TILE = 128
#: Annuli that a tile has looked into after each round; the last round takes all that its bounds leave.
ROUNDS = (4, 32, 256, MAX_PIVOTS * MAX_RINGS)
#: Pairs of a tile and a block that leave a task in one batch.
PAIRS = 64
LIMIT = 2**31 - 1


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, vector) of the rows that take part: floor(scale x) of each component x as a double, held within 32 bits.

    Rows whose vector is null or has a null, infinite or not-a-number component, or whose identifier is null, take no part.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v * scale))).cast("int"))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("vector"))


def padded(vector: Column, width: int) -> Column:
    """The vector at the common width; shorter ones end in zeros, which add nothing to a product."""
    return F.when(F.size(vector) == width, vector).otherwise(F.concat(vector, F.array_repeat(F.lit(0), F.lit(width) - F.size(vector))))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0), np.int32)


def squares(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float64)
    return np.einsum("ij,ij->i", a, a)


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    d = squares(a)[:, None] + squares(pivots)[None] - 2 * a.astype(np.float64) @ pivots.astype(np.float64).T
    return np.sqrt(np.maximum(d, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers. Doubles are exact, and fast, as long as no sum can pass 2^53."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots among the sample: each next one is the row farthest from those before; then each moves to the mean of the rows nearest to it, five times."""
    first = sample[:1]
    near = distances(sample, first)[:, 0]
    chosen = [first[0]]
    while len(chosen) < n and near.max(initial=0) > 0:
        chosen.append(sample[int(near.argmax())])
        near = np.minimum(near, distances(sample, chosen[-1][None])[:, 0])
    pivots = np.array(chosen)
    for _ in range(5):
        own = distances(sample, pivots).argmin(axis=1)
        pivots = np.array([np.rint(sample[own == i].mean(axis=0)) if (own == i).any() else p for i, p in enumerate(pivots)])
    return pivots.astype(np.int32)


def _keyed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, vector) with the nearest pivot, the distance from it and the squared length."""
    for batch in batches:
        rows = matrix_of(batch.column(1), pivots.shape[1])
        d = distances(rows, pivots)
        own = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own]), pa.array(squares(rows))], names=["id", "vector", "pivot", "distance", "square"])


_KEYED = "id bigint, vector array<int>, pivot int, distance double, square double"


@dataclass
class PivotIndex:
    """blocks(ring, slice, ids, vectors), at most about BLOCK_VALUES components each, and a directory whose size the parameters bound.

    ring counts the annuli; arrays by ring: its pivot, least and greatest distance, greatest square, number of blocks.
    """

    width: int
    pivots: np.ndarray
    of_pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    square: np.ndarray
    slices: np.ndarray
    blocks: DataFrame | None

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """What no product of a query (row) with a vector of an annulus (column) exceeds.

        2 qx = |q|^2 + |x|^2 - |q - x|^2, and by the triangle inequality |q - x| is no less than the gap between the query's distance
        from the pivot and the annulus. One and a little more makes up for rounding.
        """
        d = distances(queries, self.pivots)[:, self.of_pivot]
        gap = np.maximum(0, np.maximum(self.low - d, d - self.high))
        all_of = squares(queries)[:, None] + self.square[None]
        return (all_of - gap * gap) / 2 + 1 + 1e-9 * all_of


def build_index(vectors: DataFrame, fit_rows: int = FIT_ROWS) -> PivotIndex:
    """The index of vectors(id, vector), each in it. Only the choice of the pivots looks at a sample, of fit_rows rows at most.

    There are twice the square root of the number of blocks as pivots, MAX_PIVOTS at most. A pivot's annuli are cut at quantiles of the distance,
    one for each block's worth of its rows up to MAX_RINGS; an annulus with more rows, such as one of many equal vectors, is
    several blocks, among which its rows are dealt by their hash.
    """
    width, n = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count("*")).first()
    per_block = max(16, BLOCK_VALUES // max(1, width))
    rows = vectors.select("id", padded(F.col("vector"), width).alias("vector"))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(fit_rows).select("vector").toArrow().column(0).combine_chunks()
    empty = np.zeros(0)
    if not n:
        return PivotIndex(width, np.zeros((0, width), np.int32), empty.astype(int), empty, empty, empty, empty.astype(int), None)
    pivots = choose_pivots(matrix_of(sample, width), min(MAX_PIVOTS, 1 + int(2 * (n / per_block) ** 0.5)))
    keyed = durable(rows.mapInArrow(partial(_keyed, pivots=pivots), _KEYED))
    cuts = F.percentile_approx("distance", [i / MAX_RINGS for i in range(1, MAX_RINGS)], 1_000)
    edges: dict[int, list[float]] = {}
    for r in keyed.groupBy("pivot").agg(F.count("*").alias("n"), cuts.alias("cuts")).collect():  # one row a pivot
        rings = min(MAX_RINGS, -(-r.n // per_block))
        edges[r.pivot] = sorted({r.cuts[round(i * MAX_RINGS / rings) - 1] for i in range(1, rings)})
    table = rows.sparkSession.createDataFrame(sorted(edges.items()), "pivot int, edges array<double>")
    place = F.size(F.filter("edges", lambda e: e < F.col("distance")))
    ringed = keyed.join(F.broadcast(table), "pivot").withColumn("place", place)  # MAX_PIVOTS rows
    directory = ringed.groupBy("pivot", "place").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("square").alias("square"), F.count("*").alias("n")).orderBy("pivot", "place").collect()
    slices = [-(-r.n // per_block) for r in directory]
    numbers = rows.sparkSession.createDataFrame([(r.pivot, r.place, i, s) for i, (r, s) in enumerate(zip(directory, slices))], "pivot int, place int, ring int, slices int")
    dealt = ringed.join(F.broadcast(numbers), ["pivot", "place"]).withColumn("slice", F.pmod(F.xxhash64("id", "distance", F.monotonically_increasing_id()), F.col("slices")).cast("int"))  # MAX_PIVOTS x MAX_RINGS rows
    packed = dealt.groupBy("ring", "slice").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    blocks = durable(packed.select("ring", "slice", F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("vectors")))
    discard(keyed)
    of = lambda f, kind=float: np.array([f(r) for r in directory], kind)
    return PivotIndex(width, pivots, of(lambda r: r.pivot, int), of(lambda r: r.low), of(lambda r: r.high), of(lambda r: r.square), np.array(slices), blocks)


def _open(batches: Iterator[pa.RecordBatch], index: PivotIndex, since: int, until: int) -> Iterator[pa.RecordBatch]:
    """Tiles to what they still ask for: a row for each block of an annulus that a query of the tile can't do without.

    A tile takes its annuli in the order of its highest bound for them, since to until in this round; within them, a query asks only
    where its bound reaches the score of its k-th hit so far. Equal bounds count, since ties go by identifier.
    """
    for batch in batches:
        for t in range(batch.num_rows):
            ids = np.asarray(batch.column(0)[t].values)
            queries = batch.column(1)[t].values.to_numpy().reshape(-1, index.width) if index.width else np.zeros((len(ids), 0), np.int32)
            floor = batch.column(2)[t].values.to_numpy(zero_copy_only=False)
            upper = index.upper(queries)
            order = np.argsort(-upper.max(axis=0), kind="stable")[since:until]
            asks = [(ring, np.flatnonzero(upper[:, ring] >= floor)) for ring in order]
            out = ((int(ring), s, ids[a], queries[a].ravel(), floor[a]) for ring, a in asks if len(a) for s in range(index.slices[ring]))
            while some := list(islice(out, PAIRS)):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*some), _PAIR)], names=["ring", "slice", "query_ids", "queries", "floor"])


_PAIR = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()))


def _hits(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(query_ids, queries, floor, ids, vectors) to (query_id, vec_id, score): of each pair of a tile and a block the k best of each query, and none under its floor."""
    for batch in batches:
        q_out, v_out, s_out = [], [], []
        for i in range(batch.num_rows):
            asked, floor, own = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            found = products(batch.column(1)[i].values.to_numpy(zero_copy_only=False).reshape(len(asked), width), batch.column(4)[i].values.to_numpy(zero_copy_only=False).reshape(len(own), width))
            for q, scores, least in zip(asked, found, floor):
                at = np.flatnonzero((own != q) & (scores >= least))
                if len(at) > k:
                    at = at[np.lexsort((own[at], -scores[at]))[:k]]
                q_out.append(np.full(len(at), q))
                v_out.append(own[at])
                s_out.append(scores[at])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (q_out, v_out, s_out)], names=["query_id", "vec_id", "score"])


def top_k(index: PivotIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each of queries(id, vector) with the index, without its own identifier; ties to the smaller vec_id.

    Queries near each other share a tile. In each round tiles are joined with the blocks that they still ask for, the hits merged with those
    before, and the k-th score of a query lets the triangle inequality close more annuli. What the bounds close is never read; where
    they close nothing, as with vectors without any clusters, this is every query against every block, and the result is as exact.
    """
    spark = queries.sparkSession
    none = spark.range(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    if index.blocks is None:
        return none
    width = max(index.width, queries.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0])
    once = queries.groupBy("id").agg(F.max("vector").alias("vector"))
    # what a query has beyond the index's width meets zeros only
    fitted = once.select("id", F.slice(padded(F.col("vector"), width), 1, index.width).alias("vector"))
    asked = durable(fitted.mapInArrow(partial(_keyed, pivots=index.pivots), _KEYED))
    per_pivot = asked.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tiled = durable(asked.join(F.broadcast(per_pivot), "pivot").select("id", "vector", "pivot", F.pmod(F.xxhash64("id"), F.col("tiles")).alias("tile")))  # MAX_PIVOTS rows
    discard(asked)
    best, since = None, 0
    for until in ROUNDS:
        if since >= len(index.slices):
            break
        floors = F.lit(float("-inf")) if best is None else F.coalesce(F.col("floor"), F.lit(float("-inf")))
        with_floor = tiled if best is None else tiled.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor")), "id", "left")
        grouped = with_floor.select("pivot", "tile", "id", "vector", floors.alias("floor")).groupBy("pivot", "tile").agg(F.collect_list(F.struct("id", "vector", "floor")).alias("q"))
        tiles = grouped.select(F.col("q.id").alias("ids"), F.flatten("q.vector").alias("queries"), F.col("q.floor").alias("floor"))
        pairs = tiles.mapInArrow(partial(_open, index=_directory(index), since=since, until=until), "ring int, slice int, query_ids array<bigint>, queries array<int>, floor array<double>")
        hits = _met(pairs, index.blocks).mapInArrow(partial(_hits, width=index.width, k=k), "query_id bigint, vec_id bigint, score bigint")
        hits = hits if best is None else best.select("query_id", "vec_id", "score").unionByName(hits)
        found = durable(_ranked(hits, k))
        if best is not None:
            discard(best)
        best, since = found, until
    discard(tiled)
    return best.select("query_id", "rank", "vec_id", "score")


def _directory(index: PivotIndex) -> PivotIndex:
    """The index without its blocks, as it goes to tasks."""
    return PivotIndex(index.width, index.pivots, index.of_pivot, index.low, index.high, index.square, index.slices, None)


def _met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs with their blocks, always by a merge: Spark takes pairs for as small as the tiles they are made of, and would send them through the driver to all tasks."""
    return pairs.hint("merge").join(blocks, ["ring", "slice"]).select("query_ids", "queries", "floor", "ids", "vectors")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): exact top k of queries among vectors by the inner product of floor(scale x), both tables with id_col and vector_col.

    Nulls: rows without identifier or vector, or with a null or non-finite component, take no part on either side. Vectors of unequal
    length count as if the shorter ended in zeros; an empty one scores 0 with all. Rows that repeat an identifier are candidates each, for all queries but those of
    the same identifier; of query rows with one identifier the greatest vector asks. Ties go to the smaller vec_id. A query with fewer
    candidates than k has them all; empty tables give no rows. Components are held within 32 bits. Other columns are not read.
    """
    return top_k(build_index(integer_vectors(vectors, id_col, vector_col, scale)), integer_vectors(queries, id_col, vector_col, scale), k)
