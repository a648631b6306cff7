"""Web pages: links, a bounded crawl over a page table, page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx

MAX_BYTES = 10 * 1024 * 1024


def absolute(base: Column, href: Column) -> Column:
    """href as seen from base, for absolute, scheme-relative, root-relative, query, and plain relative references; dot segments are folded."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, path, href))
        .when(href.startswith("#") | (href == ""), base)
        .otherwise(F.concat(site, folder, href))
    )
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, r"(?<!/)/\./", "/"), r"/(?!\.\.)[^/:]+/\.\./", "/")
    return joined


def links(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url): distinct normalised links of pages(url, html); mail, script and data links are none."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    each = pages.select(F.col("url").alias("base"), F.explode(hrefs).alias("href")).where(~F.col("href").rlike("(?i)^(mailto|javascript|data|tel):"))
    return each.select(tx.normal_url(F.col("base")).alias("src_url"), tx.normal_url(absolute(F.col("base"), F.trim("href"))).alias("dst_url")).distinct()


def url_passes(url: Column, includes: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> Column:
    """Any of the includes, if there are some, and none of the excludes, as substrings."""
    any_of = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(url, x))
    out = any_of(includes) if includes else F.lit(True)
    return out & ~any_of(excludes) if excludes else out


def fetchable(status: Column, content_type: Column, html: Column) -> Column:
    return (F.coalesce(status, F.lit(200)) < 400) & F.coalesce(content_type, F.lit("text/html")).rlike("(?i)^(text/html|application/xhtml\\+xml)") & (F.octet_length(F.coalesce(html, F.lit(""))) <= MAX_BYTES)


def crawl(pages: DataFrame, start_url: str, max_depth: int = 3, max_pages: int = 200, same_origin: bool = True, includes: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth, position) of the pages that a breadth-first crawl of pages(url, html[, status, content_type]) emits.

    The seed is always read, also if it passes no filter, but only emitted if it does; excludes hold for it too. Pages that
    can't be fetched end there. Within a level pages are taken in order of url; max_pages counts emitted ones.
    """
    have = lambda name, default: F.col(name) if name in pages.columns else F.lit(default)
    known = pages.select(tx.normal_url(F.col("url")).alias("url"), "html", have("status", 200).alias("status"), have("content_type", "text/html").alias("content_type")).dropDuplicates(["url"])
    good = known.where(fetchable(F.col("status"), F.col("content_type"), F.col("html")))
    steps = links(good)
    if same_origin:
        steps = steps.where(tx.origin(F.col("src_url")) == tx.origin(F.col("dst_url")))
    steps = steps.where(url_passes(F.col("dst_url"), includes, excludes)).join(good.select(F.col("url").alias("dst_url")), "dst_url", "left_semi")
    seed = good.where((F.col("url") == tx.normal_url(F.lit(start_url))) & url_passes(F.col("url"), (), excludes))
    level = seed.select("url")
    found = level.withColumn("depth", F.lit(0))
    for d in range(1, max_depth + 1):
        level = level.join(steps, level.url == steps.src_url).select(F.col("dst_url").alias("url")).distinct()
        found = found.unionByName(level.withColumn("depth", F.lit(d)))
    least = found.groupBy("url").agg(F.min("depth").alias("depth")).where(url_passes(F.col("url"), includes, excludes))
    first = least.orderBy("depth", "url").limit(max_pages)
    return first.withColumn("position", F.row_number().over(Window.orderBy("depth", "url")))  # max_pages rows
