"""Budgeted breadth-first crawl of a link graph, and discovery of a site's URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import excluded, same_host, url_scheme
from .checkpoints import shared_checkpoints


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_pages: int | None = None, scope: str = "domain", exclude: list[str] | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(url, depth) of the pages a crawl attempts, level by level from ``seeds`` (url) over ``edges`` (src, dst).

    A page at ``max_depth`` is attempted but not expanded; a failed page (``failed``: url) uses the budget but is not
    expanded; a URL counts as visited when it is first seen. Order within the budget is (depth, url); what a cut level
    leaves over is dropped. ``scope``: ``page`` follows no link; ``domain`` and ``subdomain`` alike follow the web links of a
    page to its own host (only links within a host are ever followed, so that a base domain adds nothing); ``all`` follows
    every link. At most ``max_depth`` + 1 levels; each is cut by a checkpoint, visited URLs go by anti-join."""
    spark = seeds.sparkSession
    shared_checkpoints(spark)
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    if exclude:
        links = links.where(~excluded(F.col("dst"), exclude))
    if scope == "page":
        links = links.where(F.lit(False))
    elif scope != "all":
        links = links.where(url_scheme(F.col("dst")).isin("http", "https") & same_host(F.col("dst"), F.col("src")))
    links = links.distinct().checkpoint(eager=True)  # scanned and shuffled once, not at each level
    frontier = seeds.where("url IS NOT NULL").select("url").distinct()
    visited, result, used = None, None, 0
    for depth in range(max_depth + 1):
        level = frontier.select("url", F.lit(depth).cast("bigint").alias("depth"))
        if max_pages is not None:
            # the level's first pages by url: TakeOrdered, no global sort beyond the budget
            level = level.orderBy("url").limit(max_pages - used)
        level = level.checkpoint(eager=True)
        taken = level.count()
        result = level if result is None else result.unionByName(level)
        used += taken
        if not taken or depth == max_depth or max_pages is not None and used >= max_pages:
            break
        visited = frontier if visited is None else visited.union(frontier)
        grow = level.select("url")
        if failed is not None:
            grow = grow.join(failed, "url", "left_anti")
        seen = visited.withColumnRenamed("url", "dst")
        frontier = grow.join(links, grow["url"] == links["src"]).select("dst").distinct().join(seen, "dst", "left_anti").select(F.col("dst").alias("url")).checkpoint(eager=True)
    return result


def crawl_status(results: DataFrame) -> DataFrame:
    """One row: total, ok, failed and status of a crawl's results (success)."""
    n = results.agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
    return n.withColumn("failed", F.col("total") - F.col("ok")).withColumn(
        "status", F.when((F.col("total") > 0) & (F.col("failed") == F.col("total")), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    )


def discover(*sources: DataFrame) -> DataFrame:
    """Distinct non-blank URLs of any number of (url) tables: sitemaps, robots, links."""
    out = sources[0].select("url")
    for s in sources[1:]:
        out = out.union(s.select("url"))
    return out.where("trim(url) <> ''").distinct()


def robots_sitemaps(robots: DataFrame, body: str = "body") -> DataFrame:
    """(…, url) of the sitemap lines of robots texts; the keyword in any case, blanks dropped."""
    lines = robots.withColumn("line", F.explode(F.split(F.col(body), "\n"))).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    hit = lines.where(F.lower(F.substring("line", 1, 8)) == "sitemap:")
    return hit.withColumn("url", F.regexp_replace(F.substring("line", 9, 1 << 20), r"^\s+|\s+$", "")).where("url <> ''").drop("line", body)


def sitemap_locations(docs: DataFrame, body: str = "body") -> DataFrame:
    """(…, kind, url) of sitemap documents: ``index`` entries if there are any, else ``url`` entries; blanks and
    malformed documents give nothing."""
    entry = "array<struct<loc: string>>"
    parsed = docs.withColumn("x", F.from_xml(F.col(body), f"sitemap {entry}, url {entry}", {"mode": "PERMISSIVE"}))
    index, urls = F.transform("x.sitemap", lambda s: F.trim(s["loc"])), F.transform("x.url", lambda s: F.trim(s["loc"]))
    index = F.filter(index, lambda u: u.isNotNull() & (u != ""))
    urls = F.filter(urls, lambda u: u.isNotNull() & (u != ""))
    is_index = F.coalesce(F.size(index), F.lit(0)) > 0
    picked = parsed.withColumn("kind", F.when(is_index, "index").otherwise("url")).withColumn("url", F.explode(F.when(is_index, index).otherwise(urls)))
    return picked.drop("x", body)


def expand_sitemaps(roots: DataFrame, documents: DataFrame, depth: int = 10) -> DataFrame:
    """URLs reached from root sitemaps (url) through nested indexes, given all documents (url, body). Cyclic indexes
    end: a document is opened once; ``depth`` bounds the levels."""
    shared_checkpoints(roots.sparkSession)
    entries = sitemap_locations(documents.select(F.col("url").alias("at"), "body")).checkpoint(eager=True)
    frontier, seen, found = roots.select(F.col("url").alias("at")).distinct(), None, None
    for _ in range(depth):
        got = frontier.join(entries, "at")
        pages = got.where("kind = 'url'").select("url")
        found = pages if found is None else found.union(pages)
        seen = frontier if seen is None else seen.union(frontier)
        frontier = got.where("kind = 'index'").select(F.col("url").alias("at")).distinct().join(seen, "at", "left_anti").checkpoint(eager=True)
        if frontier.isEmpty():
            break
    return found.distinct()
