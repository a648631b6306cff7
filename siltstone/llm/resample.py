"""Importance resampling towards a target distribution of hashed n-grams: every different text is looked at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, parts

#: Bytes that stand in no word become a space, A-Z become a-z; digits, letters and all bytes over 127 stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Features that a task turns into one Arrow batch at most, so that a run of long texts doesn't pile up.
BATCH_FEATURES = 200_000
#: Texts that a task weighs at a time.
TEXTS = 500


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased in A-Z only, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def feature_codes(words: list[bytes], orders: int = 2) -> np.ndarray:
    """The CRC-32 of all runs of 1 to orders words, joined by one space. A longer run goes on from the code of the one it extends."""
    codes = [list(map(crc32, words))]
    for n in range(1, orders):
        codes.append(list(map(crc32, words[n:], map(crc32, repeat(b" "), codes[-1]))))
    return np.fromiter(chain.from_iterable(codes), np.int64, sum(map(len, codes)))


def _features(batches: Iterator[pa.RecordBatch], buckets: int, orders: int) -> Iterator[pa.RecordBatch]:
    """(digest, copies, text) to (digest, copies, n_words, n_features, bucket, times): the buckets that a text has, ascending, and how often."""
    kinds = {"n_words": pa.int64(), "n_features": pa.int64(), "bucket": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}

    def made(at: list[int], batch: pa.RecordBatch, own: list) -> pa.RecordBatch:
        offsets = pa.array(np.cumsum([0] + [len(b) for *_, b, _ in own]), pa.int32())
        flat = [np.concatenate([r[i] for r in own]) for i in (2, 3)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in zip(flat, (pa.int32(), pa.int32()))]
        kept = batch.select([0, 1]).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *[pa.array([r[i] for r in own], pa.int64()) for i in (0, 1)], *lists], names=["digest", "copies", *kinds])

    for batch in batches:
        at, own, held = [], [], 0
        for i in range(batch.num_rows):
            words = words_of(batch.column(2)[i].as_py())
            codes = feature_codes(words, orders)
            bucket, times = np.unique(codes % buckets, return_counts=True)
            at.append(i)
            own.append((len(words), len(codes), bucket, times))
            held += len(bucket)
            if held > BATCH_FEATURES:
                yield made(at, batch, own)
                at, own, held = [], [], 0
        if own:
            yield made(at, batch, own)


def distinct_features(docs: DataFrame, text_col: str = "text", buckets: int = 10_000, orders: int = 2) -> DataFrame:
    """(digest, copies, n_words, n_features, bucket, times): one row for each different text of docs, with the number of its rows.

    Texts are grouped whole, and tasks count their own copies before the exchange, so a text that fills a third of the table
    is one row for each task. Null counts as empty.
    """
    once = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = once.select(digest_of(F.col("text")).alias("digest"), "copies", "text")
    return keyed.mapInArrow(partial(_features, buckets=buckets, orders=orders), "digest binary, copies bigint, n_words bigint, n_features bigint, bucket array<int>, times array<int>")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_counts(features: DataFrame) -> DataFrame:
    """(bucket, n) over all rows that the texts stand for; tasks add up before the exchange, and there is one row a bucket."""
    each = features.select("copies", F.explode(F.arrays_zip("bucket", "times")).alias("f"))
    return each.groupBy(F.col("f.bucket").alias("bucket")).agg(F.sum(F.col("copies") * F.col("f.times").cast("long")).alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))): buckets numbers, whatever the input.

    source and target are bucket_counts. The logarithm is taken by Spark.
    """
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    all_of = durable(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    total = all_of.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    each = all_of.unionByName(source.sparkSession.range(1).select(F.lit(-1).alias("bucket"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t")))  # -1: a bucket that has none
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = each.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()  # total is one row; rows are buckets + 1 at most
    discard(all_of)
    found = {r.bucket: r.gain for r in rows}
    out = np.full(buckets, found.pop(-1), np.int64)
    out[np.fromiter(found, np.int64, len(found))] = np.fromiter(found.values(), np.int64, len(found))
    return out


def _weights(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(digest, copies, n_words, n_features, bucket, times) to (digest, copies, n_words, n_features, weight)."""
    for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
        bucket, times = batch.column(4), batch.column(5)
        ends = np.append(0, np.cumsum(gains[bucket.flatten().to_numpy()] * times.flatten().to_numpy().astype(np.int64)))
        lengths = bucket.value_lengths().to_numpy()
        edge = np.append(0, np.cumsum(lengths))
        sums = ends[edge[1:]] - ends[edge[:-1]]
        n = batch.column(3).to_numpy()
        weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], names=["digest", "copies", "n_words", "n_features", "weight"])


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight): the mean of the gains over a text's features, floored; without features 0."""
    return features.mapInArrow(partial(_weights, gains=gains), "digest binary, copies bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_text: Column, seed: str) -> Column:
    """A Gumbel variable in thousandths from a hash of seed and identifier: floor(-1000 ln(-ln((h + 0.5) / 2^32)))."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _joined(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows(digest, ...) with the columns of weights(digest, copies, ...), one row a digest.

    A text that fills more than a task's even share of the rows is hot. There are fewer such texts than tasks, so their weights go to all
    tasks, which is counted by that bound; the others' copies fit a task and are joined by digest.
    """
    tasks = parts(rows.sparkSession)
    share = weights.agg(F.ceil(F.coalesce(F.sum("copies"), F.lit(0)) / tasks).alias("share"))
    told = weights.join(F.broadcast(share))  # one row
    hot = told.where(F.col("copies") > F.col("share")).drop("share", "copies")  # fewer than tasks
    cold = told.where(F.col("copies") <= F.col("share")).drop("share", "copies")
    spread = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    return spread.where("hot").drop("hot").join(F.broadcast(hot), "digest").unionByName(spread.where("hot is null").drop("hot").join(cold, "digest"))


def ranked(rows: DataFrame, best: int, order: list[Column]) -> DataFrame:
    """The first rows of a global order, numbered from 1 in the column rank; best of them.

    Rows are dealt by ranges of the order and sorted where they are; a range's first number is the rows of all ranges before it, one
    number a range. No task sees more than a range.
    """
    dealt = durable(rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes, before, at = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect(), {}, 0  # one row a range
    for r in sizes:
        before[r.part] = at
        at += r.n
    needed = {p: n for p, n in before.items() if n < best}
    if not needed:
        return dealt.where(F.lit(False)).withColumn("rank", F.lit(0).cast("long")).drop("place")
    starts = rows.sparkSession.createDataFrame(sorted(needed.items()), "part int, before bigint")
    numbered = dealt.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part")  # one row a range
    numbered = numbered.withColumn("rank", F.col("before") + F.col("place") - F.shiftleft(F.col("part").cast("long"), 33) + 1)
    return numbered.where(F.col("rank") <= best).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: float = 25, min_words: int = 20, buckets: int = 10_000, orders: int = 2, seed: str = "7") -> DataFrame:
    """One row for each input row: id, n_features, weight, score, rank (null where it isn't drawn).

    Equal texts are collapsed first: whole texts are grouped, features and weight of each are made once, and its counts are multiplied
    by its number of rows. Weights then go back to the rows, and only there each gets the noise of its own identifier, so copies are
    drawn apart. The draw takes the highest floor(share N / 100) scores of the N rows with min_words words or more, without replacement,
    ties to the smaller identifier; ranks come from ranges of the order, not from one sorted task.

    target is any table of texts that stand for what is wanted. Nulls: a null text is empty, weight 0, never drawn; a null identifier
    has the noise of the empty string and comes last among equal scores. Rows with equal identifier and text are equal rows; each can be drawn, in
    either order. Very long texts are counted whole, a text at a time. Tables may be empty on either side: without a target all gains
    come from the source's counts alone; without documents there are no rows. Other columns, whatever their names, are not read.
    """
    rows = durable(docs.select(F.col(id_col).alias("id"), digest_of(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")))
    features = durable(distinct_features(docs, text_col, buckets, orders))
    wanted = distinct_features(target, target_text, buckets, orders)
    weights = durable(text_weights(features, bucket_gains(bucket_counts(features), bucket_counts(wanted), buckets)))
    discard(features)
    scored = _joined(rows, weights).select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id").cast("string"), seed)).alias("score"))
    scored = durable(scored.withColumn("row_no", F.monotonically_increasing_id()))
    n = scored.where(F.col("n_words") >= min_words).count()
    drawn = ranked(scored.where(F.col("n_words") >= min_words).select("id", "score", "row_no"), int(share * n // 100), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row_no").asc()])
    return scored.join(drawn.select("row_no", "rank"), "row_no", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
