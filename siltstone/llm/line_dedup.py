"""Line deduplication by site-relative frequency: lines on too many of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, unused

#: Rules up to this many are broadcast; more are joined by host and salt.
BROADCAST_RULES = 200_000
SALTS = 64


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 10) -> DataFrame:
    """host, line_md5, pages, host_pages: the lines on more than ratio of the pages of a host with min_pages pages or more.

    Lines are whole lines between line feeds; the empty line never counts. A page counts once for a line that it repeats.
    Only hashes are exchanged, and each task first adds up its own: a line on every page is one row a task.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_pages)
    lines = pages.select("host", F.explode(F.array_distinct(F.split("t", "\n", -1))).alias("line")).where("line <> ''")
    counts = lines.groupBy("host", F.unhex(F.md5("line")).alias("line_md5")).agg(F.count("*").alias("pages")).where(F.col("pages") > ratio * min_pages)
    rules = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return rules.where(F.col("pages") > ratio * F.col("host_pages"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 10) -> DataFrame:
    """docs with the boilerplate lines of each one's host taken out of text_col, and n_lines and n_dropped of each.

    All columns and rows stay, also rows whose text becomes empty. Null text stays null, with 0 lines; a null host is a
    host of its own. Columns n_lines and n_dropped of the input are replaced, others keep their names and values whatever they are called. Very long
    texts are split whole. An empty table gives an empty result.

    A host has fewer such lines than its mean of distinct lines a page divided by ratio, so the rules of one host are a small
    array whatever the number of its pages. The rules of all hosts are broadcast up to BROADCAST_RULES lines, counted first;
    beyond that the join goes by host and salt, so that a host with a third of all pages is spread over SALTS tasks.
    """
    rules = durable(boilerplate_lines(docs, text_col, host_col, ratio, min_pages))
    n_rules = rules.count()
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*rest)
    rule_host, rule_lines, rule_salt, doc_salt, kept_lines = (unused(docs, c) for c in ("__rule_host", "__rule_lines", "__rule_salt", "__doc_salt", "__kept_lines"))
    by_host = rules.groupBy(F.col("host").alias(rule_host)).agg(F.collect_set("line_md5").alias(rule_lines))
    same_host = F.col(host_col).eqNullSafe(F.col(rule_host))
    if n_rules <= BROADCAST_RULES:
        joined = docs.join(F.broadcast(by_host), same_host, "left")
    else:
        salted = by_host.withColumn(rule_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int")
        joined = docs.withColumn(doc_salt, salt).join(salted, same_host & (F.col(doc_salt) == F.col(rule_salt)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains(rule_lines, F.unhex(F.md5(x))))
    done = joined.withColumn(kept_lines, F.when(F.col(rule_lines).isNull(), lines).otherwise(kept))
    done = done.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
    done = done.withColumn("n_dropped", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size(kept_lines)).cast("long"))
    return done.select(*[F.array_join(kept_lines, "\n").alias(c) if c == text_col else F.col(c) for c in rest], "n_lines", "n_dropped")
