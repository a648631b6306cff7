"""Mixing sources to target weights: weighted sampling without replacement to word budgets, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

#: Rows that one task sorts at least; from there on the square root of a source's rows.
SLICE_ROWS = 2_000


def default_quality(size: Column, n_chars: Column) -> Column:
    """1 for texts whose words have 2 to 12 characters in the mean, white space included, else 1/2."""
    return F.when(n_chars.between(size * 2, size * 12), F.lit(1.0)).otherwise(F.lit(0.5))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size, n_rows), one row a source, with target.

    Sources in code point order, null last, take the weights in turn. The targets share the sum of all sizes in
    proportion to the weights; no target exceeds max_epochs times its source's size, and what is over is shared again by
    weight. Where that ends, every target is the lesser of its cap and its weight times one common level. Taking sources by
    cap over weight, the level is the greatest of (sum of sizes - caps before) / (weights not before).

    One row a source is sorted in one task; there are as many rows as sources, not documents.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    placed = placed.withColumn("cap", F.col("source_size") * max_epochs)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = placed.withColumn("own_level", level).withColumn("level", F.max("own_level").over(all_rows))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return levelled.select("source", "source_size", "n_rows", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=default_quality, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", keep_row: bool = False) -> DataFrame:
    """One row for each input row: id, size, source_size, target (of its source), taken (words that the mix takes).

    The draw is Efraimidis and Spirakis': a document's key is -ln(u) / quality, with u from a hash of seed and identifier,
    so reruns agree. A source first gives whole epochs of all its documents, then its documents by ascending key until the
    words that its target still lacks are reached; the last document gives just the words that are missing. So each source's
    words equal its rounded target, and none exceeds max_epochs times a document's size.

    The prefix sums are made in slices: the monotone 1 - exp(-key) cuts each source into slices of about the square root of
    its rows (SLICE_ROWS at least), the slices' sums are added up, and only within a slice are rows sorted. The largest source
    is so many tasks, not one.

    quality: a function of the columns size and n_chars giving a positive weight. Null text has size 0. A null source is a
    source of its own, in the last place. A null identifier is drawn as the empty string. Rows with equal identifiers are
    drawn one after the other, the smaller first; rows equal in all of it are interchangeable. Documents of size 0 take
    nothing; an empty table gives an empty result. keep_row: also row_no, the input row's number, and the text's columns stay
    with the caller.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text.alias("t")).select(
        "id",
        "source",
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("size"),
        F.char_length("t").cast("long").alias("n_chars"),
        F.xxhash64("t").alias("text_hash"),
    )
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    rows = durable(rows.select("id", "source", "size", "text_hash", (-F.log(u) / quality(F.col("size"), F.col("n_chars"))).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = durable(source_targets(sizes, weights, max_epochs))
    whole = F.floor(F.col("target") + 0.5).cast("long")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.greatest(F.lit(float(SLICE_ROWS)), F.sqrt("n_rows"))))
    plan = targets.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        slices.cast("int").alias("slices"),
        F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("source_size") > 0, whole % F.col("source_size")).otherwise(0).cast("long").alias("rest"),
    )
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("slice", F.least(F.col("slices") - 1, F.floor((1 - F.exp(-F.col("key"))) * F.col("slices")).cast("int")))
    sums = dealt.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("slice").alias("sl"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"))
    dealt = dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).drop("s", "sl")
    within = Window.partitionBy("source", "slice").orderBy("key", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("words_before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    out = dealt.withColumn("taken", F.col("size") * F.col("epochs") + F.least(F.col("size"), F.greatest(F.lit(0), left)))
    more = [F.col("text_hash")] if keep_row else []
    return out.select(F.col("id").alias(id_col), *([F.col("source").alias(source_col)] if keep_row else []), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), *more)
