"""Stored postings: blocks by term, best first, each with a bound of what it can give, kept in a commit log and changed by chunk.

Tables of the log: blocks(bucket, term, lead, n, max_tf, min_dl, ids, tfs, dls), in folders by bucket; retired(term, n), how many of a
term's postings are of chunks that are gone; sizes(n, total), whose sums are the number of chunks and of their terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.sources.store import Change, Log, State

from .lineage import checkpointed
from .ranking import ASKED_ROWS, postings, ranked, top

#: Postings of a block, and folders that terms are dealt to.
BLOCK, BUCKETS = 128, 64
K1, B = 1.5, 0.75
#: Rows with bounds this little under the k-th score still count, since scores are rounded.
SLACK = 1e-4


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _packed(batches: Iterator[pa.RecordBatch], block: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(bucket, term, id, tf, dl), sorted, to blocks of rows of one term that follow each other."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column(1).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        lengths = np.diff(np.append(starts, batch.num_rows))
        lead = np.concatenate([np.arange(0, n, block) for n in lengths])
        first = np.concatenate([s + np.arange(0, n, block) for s, n in zip(starts, lengths)])
        ends = np.append(first[1:], batch.num_rows)
        offsets = pa.array(np.append(first, batch.num_rows), pa.int32())
        tf, dl = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        is_lead = lead == 0
        if last == batch.column(1)[0].as_py():
            is_lead[0] = False  # goes on from the batch before
        last = batch.column(1)[batch.num_rows - 1].as_py()
        head = batch.select([0, 1]).take(pa.array(first, pa.int64()))
        lists = [pa.ListArray.from_arrays(offsets, c) for c in (batch.column(2).cast(id_type), batch.column(3).cast(pa.int32()), batch.column(4).cast(pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [head.column(0), head.column(1), pa.array(is_lead), pa.array(ends - first, pa.int32()), pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(dl, first), pa.int32()), *lists],
            names=["bucket", "term", "lead", "n", "max_tf", "min_dl", "ids", "tfs", "dls"],
        )


def blocks_of(chunks: DataFrame, text_col: str = "content", block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of the chunks' postings. Rows are dealt by ranges of bucket, term and impact, so a term that every chunk has is many tasks' work."""
    kind = chunks.schema["id"].dataType
    post = postings(chunks, "id", text_col).select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "id", "tf", "dl")
    order = [F.col("bucket"), F.col("term"), F.col("tf").desc(), F.col("dl"), F.col("id")]
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = pa.string() if kind.simpleString() == "string" else pa.int64()
    name = "string" if kind.simpleString() == "string" else "bigint"
    dealt = post.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda batches: _packed(batches, block, id_type), f"bucket int, term string, lead boolean, n int, max_tf int, min_dl int, ids array<{name}>, tfs array<int>, dls array<int>")


def size_of(chunks: DataFrame, text_col: str = "content", sign: int = 1) -> DataFrame:
    """One row: how many chunks come (or, with -1, go) and how many terms they have."""
    sizes = chunks.select(F.size(tx.tokens(F.col(text_col))).alias("dl"))
    return sizes.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("total"))


def changes(fresh: DataFrame | None, gone: DataFrame | None = None, text_col: str = "content", buckets: int = BUCKETS) -> dict[str, Change]:
    """The log's changes for chunks(id, content) that come and stored chunks(id, content) that go; both are read, nothing else is."""
    rows = blocks_of(fresh, text_col, buckets=buckets) if fresh is not None else None
    out = {"blocks": Change(rows, gone.select(F.col("id").alias("id")) if gone is not None else None, "id")}
    sizes = [size_of(c, text_col, s) for c, s in ((fresh, 1), (gone, -1)) if c is not None]
    out["sizes"] = Change(sizes[0] if len(sizes) == 1 else sizes[0].unionByName(sizes[1]), key="")
    none = (fresh if fresh is not None else gone).sparkSession.createDataFrame([], "term string, n bigint")
    lost = postings(gone, "id", text_col).groupBy("term").agg(F.count("*").alias("n")) if gone is not None else none
    out["retired"] = Change(lost, key="")
    return out


class PostingIndex:
    """The postings of a log's chunks at a commit; see ranking.bm25 for the scores, which are the same."""

    def __init__(self, log: Log, state: State | None = None, buckets: int = BUCKETS):
        self.log, self.state, self.buckets = log, state or log.state(), buckets

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """All blocks, or those in the folders of terms(term); the folders' numbers, fewer than buckets, go to the driver for Spark to leave the others unread."""
        rows, _ = self.log.segments("blocks", self.state)
        if terms is None:
            return rows
        wanted = [r.bucket for r in terms.select(bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct().collect()]
        return rows.where(F.col("bucket").isin(wanted)) if wanted else rows.where(F.lit(False))

    def _live(self, exploded: DataFrame) -> DataFrame:
        """Postings without those of chunks that are gone since their segment."""
        _, gone = self.log.segments("blocks", self.state)
        return exploded if gone is None else Log.without(exploded, gone, "id")

    def flat(self, df: bool = False) -> DataFrame:
        """(id, dl, term, tf), as ranking.postings gives them; with df also the number of the term's postings.

        A term with one block, as most have, has the block's number of postings; only those with several or with retired ones, few, are looked up.
        """
        blocks, more = self.blocks(), []
        if df:
            found = blocks.groupBy("term").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"))
            retired = self.log.table("retired", self.state).groupBy("term").agg(F.sum("n").alias("lost"))
            changed = found.join(retired, "term", "left").where("blocks > 1 OR lost IS NOT NULL")
            several = checkpointed(changed.select("term", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("df")))
            hint = F.broadcast if several.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS else lambda t: t  # counted
            blocks, more = blocks.join(hint(several), "term", "left").withColumn("df", F.coalesce("df", F.col("n").cast("long"))), ["df"]
        each = blocks.select("__seq", "term", *more, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return self._live(each.select("__seq", "term", *more, F.col("p.ids").alias("id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))).select("id", "dl", "term", "tf", *more)

    def _counts(self, blocks: DataFrame) -> DataFrame:
        """(term, df) of the terms of blocks."""
        retired = self.log.table("retired", self.state).select("term", (-F.col("n")).alias("n"))
        lost = retired.join(blocks.select("term").distinct(), "term", "left_semi")
        return blocks.select("term", F.col("n").cast("long").alias("n")).unionByName(lost).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def weights(self, queries: DataFrame, blocks: DataFrame, epsilon: float, query_text: str) -> DataFrame:
        """(query_id, term, weight, avgdl): qtf idf (k1 + 1). The mean idf, which needs the counts of every term, is only made where an asked term is in over half of the chunks."""
        asked = queries.select("query_id", F.explode(tx.tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        n, total = self.log.table("sizes", self.state).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        raw = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        counted = checkpointed(asked.join(self._counts(blocks), "term").select("query_id", "term", "qtf", raw.alias("raw")))
        idf = F.col("raw")
        if counted.where("raw < 0").limit(1).count():
            mean = self._counts(self.blocks()).agg(F.avg(raw)).first()[0]
            idf = F.when(idf < 0, epsilon * mean).otherwise(idf)
        return counted.select("query_id", "term", (F.col("qtf") * idf * (K1 + 1)).alias("weight"), F.lit(float(total) / n if n else 0.0).alias("avgdl"))

    def search(self, queries: DataFrame, top_n: int = 10, epsilon: float = 0.25, query_text: str = "text", prune: bool = True) -> DataFrame:
        """(query_id, id, score, rank) of queries(query_id, text): the rows of ranking.bm25 over the same chunks.

        First the lead block of each asked term is scored: a query's top_n-th score among those is one that its hits reach at least. Then a block is
        read only if its bound, with the greatest that the query's other terms can give, reaches that score. A term's blocks go by
        falling counts and rising lengths, so their bounds are tight and of a common term few are left.
        """
        asked = queries.select(F.explode(tx.tokens(F.col(query_text))).alias("term")).distinct()
        blocks = self.blocks(asked)
        weights = checkpointed(self.weights(queries, blocks, epsilon, query_text))
        few = weights.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS
        hint = F.broadcast if few else lambda df: df  # counted
        share = lambda tf, dl: tf / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
        bound = F.col("weight") * share(F.col("max_tf"), F.col("min_dl"))
        met = lambda b: b.join(hint(weights), "term").withColumn("bound", bound)
        if prune and not weights.where("weight < 0").limit(1).count():
            most = met(blocks.select("term", "max_tf", "min_dl")).groupBy("query_id", "term").agg(F.max("bound").alias("most"))
            led = self._scored(met(blocks.where("lead")), share)
            floor = top(led, top_n).where(F.col("rank") == top_n).select("query_id", F.col("score").alias("floor"))
            sums = most.groupBy("query_id").agg(F.sum("most").alias("all_of")).join(floor, "query_id", "left")
            limits = most.join(sums, "query_id").select("query_id", "term", (F.coalesce("floor", F.lit(float("-inf"))) - F.col("all_of") + F.col("most") - SLACK).alias("least"))
            # read once for all queries that need it; what that adds to the score of another is its own
            least = checkpointed(weights.join(limits, ["query_id", "term"]).select("query_id", F.col("term").alias("asked"), "weight", "avgdl", "least"))
            kept = blocks.join(hint(least), (F.col("term") == F.col("asked")) & (bound >= F.col("least")), "left_semi")
        else:
            kept = blocks
        each = self._live(kept.select("__seq", "term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("__seq", "term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")))
        return ranked(each, weights, top_n, k1=K1, b=B)

    def _scored(self, met: DataFrame, share) -> DataFrame:
        each = met.select("query_id", "__seq", "weight", "avgdl", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        each = self._live(each.select("query_id", "__seq", "weight", "avgdl", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")))
        return each.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * share(F.col("tf"), F.col("dl"))), 6).alias("score"))

    def read_share(self, queries: DataFrame, query_text: str = "text") -> tuple[int, int]:
        """Folders read for the queries, and all."""
        asked = queries.select(F.explode(tx.tokens(F.col(query_text))).alias("term")).distinct()
        return len(asked.select(bucket_of(F.col("term"), self.buckets)).distinct().collect()), self.buckets
