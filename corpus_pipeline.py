"""A corpus pipeline of five stages; each works on all that the one before kept, and its decisions take effect.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from siltstone.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC; the model is fitted to labelled documents of this input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs.select(*COLUMNS), model, threshold=TOXIC).where(F.col("__score") < TOXIC).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines on over a tenth of their source's pages; n_chars follows the text."""
    cut = line_dedup.line_dedup(docs.select(*COLUMNS), ratio=0.1, min_pages=10)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked by 0.8 of their five-word shingles, the document with the smallest identifier."""
    return simhash.drop_similar(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("__spans") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken.

    Rows are found again by identifier and text; rows that repeat both get what the mix takes of one of them.
    """
    mixed = mixing.mix_sources(docs.select(*COLUMNS), keep_row=True).where("taken > 0")
    once = mixed.groupBy(F.col("doc_id").alias("mixed_id"), "text_hash").agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")])
    same = F.col("doc_id").eqNullSafe(F.col("mixed_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return docs.select(*COLUMNS).join(once, same).drop("mixed_id", "text_hash")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The stages of toxicity, SimHash and decontamination are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
