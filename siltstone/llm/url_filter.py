"""URL filters by temporal list join: dated list entries become intervals, each capture sees the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
#: Distinct (host, time) of one listed domain and period that a task joins; a domain with more is salted.
SALTED = 50_000


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port or final dots; null if there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.+$", ""))
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """entries(domain, category, action, listed_at) as intervals: domain, category, valid_from, valid_to (exclusive; null: open).

    An entry holds until the next one for its domain and category. At equal times a removal wins over an addition; equal
    entries count once. Entries with a null in any column, or an action other than add and remove, hold for nothing.
    """
    clean = entries.select(F.lower("domain").alias("domain"), "category", "action", F.col("listed_at").cast("timestamp").alias("listed_at")).dropna().where(F.col("action").isin("add", "remove"))
    clean = clean.groupBy("domain", "category", "listed_at").agg(F.max("action").alias("action"))
    own = Window.partitionBy("domain", "category").orderBy("listed_at")
    return clean.withColumn("valid_to", F.lead("listed_at").over(own)).where("action = 'add'").select("domain", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", salted: int = SALTED) -> DataFrame:
    """One row for each capture: id, url, host, fetched_at, blocked, domain, category, listed_since.

    An entry for a domain covers it and its subdomains. Of the entries active at the fetch, the longest domain decides, then
    the first category in code point order. A capture without a host or a fetch time is not blocked; null identifiers and
    repeated captures stay as they are. Empty inputs give an empty result, or nothing blocked.

    Captures are first reduced to distinct (host, time). The domains that hosts belong to are counted with partial sums and
    only listed ones go on, so a top-level domain that every host ends in goes no further unless it is listed. The as-of
    join is an equality join on domain and 32-day period with the interval's ends beside it; a domain with many captures is
    salted, by their number. An interval is written once for each period in which its domain was captured. Hosts and domains
    of any length are read whole. Columns of captures other than the three are not read.
    """
    caps = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).cast("timestamp").alias("at"), host_of(F.col(url_col)).alias("host"))
    period = lambda t: F.floor(F.unix_seconds(t) / (32 * 86400)).cast("int")
    moments = caps.where("host is not null and at is not null").select("host", "at").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = moments.select("host", "at", F.explode(suffixes).alias("domain"), period(F.col("at")).alias("period"))
    listed = durable(validity(entries))
    counts = asked.groupBy("domain", "period").agg(F.count("*").alias("n")).join(listed.select("domain").distinct(), "domain")
    # Domains both listed and captured, by period. As a table its size is known: a small one goes to all tasks.
    wanted = durable(counts.select("domain", "period", F.ceil(F.col("n") / salted).cast("int").alias("salts")))
    asked = asked.join(wanted, ["domain", "period"]).withColumn("salt", F.pmod(F.xxhash64("host", "at"), F.col("salts")).cast("int"))
    lo, hi = period(F.col("valid_from")), period(F.col("valid_to"))
    held = listed.join(wanted, "domain").where((F.col("period") >= lo) & (F.col("valid_to").isNull() | (F.col("period") <= hi)))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    active = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    found = asked.alias("a").join(held.alias("h"), (F.col("a.domain") == F.col("h.domain")) & (F.col("a.period") == F.col("h.period")) & (F.col("a.salt") == F.col("h.salt")) & active)
    first = F.min(F.struct((-F.char_length("h.domain")).alias("shorter"), F.col("h.category").alias("category"), F.col("h.domain").alias("domain"), F.col("h.valid_from").alias("since")))
    verdict = found.groupBy(F.col("host").alias("v_host"), F.col("at").alias("v_at")).agg(first.alias("hit"))
    return caps.join(verdict, (F.col("host") == F.col("v_host")) & (F.col("at") == F.col("v_at")), "left").select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "host",
        F.col("at").alias(at_col),
        F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.domain").alias("domain"),
        F.col("hit.category").alias("category"),
        F.col("hit.since").alias("listed_since"),
    )
