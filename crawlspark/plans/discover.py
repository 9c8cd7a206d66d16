"""From start URLs to the list of selectable pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FALLBACK_CRAWL_DEPTH, FEW_URLS
from ..operators.crawl import crawl_frontier
from ..operators.dedupe import first_occurrence, language_dedupe
from ..operators.progress import over_limit
from ..operators.robots import selectable_verdict
from ..operators.scope import scope_filter
from ..operators.sitemaps import sitemap_expand
from ..session import cut_lineage
from ..sources.tables import with_sitemap_guesses


def discovery_fallback(seeds: DataFrame, sitemaps: DataFrame, responses: DataFrame,
                       edges: DataFrame, crawl_pages: int | None = None) -> DataFrame:
    """seeds (seed_id, url, host, max_urls) → seed_id, url, pos, source.

    The first sitemap address with pages wins; seeds without any are crawled one level deep, up to
    `crawl_pages` pages besides their own `max_urls` (NULL and None: no limit).
    Both addresses of all seeds are read in one expansion.
    """
    starts = with_sitemap_guesses(seeds).select("seed_id", "guess", "sitemap_url", "host", "max_urls")
    listed = cut_lineage(sitemap_expand(starts, sitemaps, ["seed_id", "guess"]))
    best = listed.groupBy("seed_id").agg(F.min("guess").alias("guess"))
    from_sitemap = listed.join(best, ["seed_id", "guess"], "left_semi").select(
        "seed_id", "url", "pos", F.concat(F.lit("sitemap_"), F.col("guess")).alias("source"))
    unlisted = seeds.join(best, "seed_id", "left_anti").select(
        "seed_id", "url", "host", F.lit(FALLBACK_CRAWL_DEPTH).alias("max_depth"),
        F.least(F.lit(crawl_pages).cast("bigint"), F.col("max_urls")).alias("max_pages"))
    crawled = crawl_frontier(unlisted, responses, edges).select(
        "seed_id", F.col("final_url").alias("url"), "pos")
    from_crawl = first_occurrence(crawled, ["seed_id"]).select(
        "seed_id", "url", "pos", F.lit("crawl_1").alias("source"))
    return from_sitemap.unionByName(from_crawl)


def discovery_mode(seeds: DataFrame, sitemaps: DataFrame, responses: DataFrame,
                   edges: DataFrame, max_list: int | None = None, crawl_pages: int | None = None) -> DataFrame:
    """seeds (seed_id, url, host, mode, crawl_depth, crawl_max_pages) → seed_id, url, pos, source.

    crawl: breadth-first crawl. sitemap: sitemaps, else one level of links. auto: the same, and a
    crawl instead when that gave fewer than three URLs. A seed's own `crawl_max_pages` bounds crawls
    and sitemaps; `max_list` bounds every list besides, `crawl_pages` the one-level crawl.
    """
    listed_most = F.lit(max_list).cast("bigint")
    pages = F.least(F.col("crawl_max_pages"), listed_most)
    by_sitemap = seeds.filter("mode <> 'crawl'").select(
        "seed_id", "url", "host",
        F.when(F.col("mode") == "auto", listed_most).otherwise(pages).alias("max_urls"))
    listed = cut_lineage(discovery_fallback(by_sitemap, sitemaps, responses, edges, crawl_pages))
    counts = listed.groupBy("seed_id").agg(F.count("*").alias("_n"))
    crawled_seeds = (
        seeds.join(counts, "seed_id", "left")
        .filter((F.col("mode") == "crawl")
                | ((F.col("mode") == "auto") & (F.coalesce("_n", F.lit(0)) < FEW_URLS)))
        .select("seed_id", "url", "host", F.col("crawl_depth").alias("max_depth"), pages.alias("max_pages"))
    )
    crawled = crawl_frontier(crawled_seeds, responses, edges).select(
        "seed_id", F.col("final_url").alias("url"), "pos", F.lit("crawl").alias("source"))
    return listed.join(crawled_seeds, "seed_id", "left_anti").select(
        "seed_id", "url", "pos", "source").unionByName(crawled)


def checked_urls(found: DataFrame, seeds: DataFrame, policy: DataFrame, max_list: int | None = None) -> DataFrame:
    """found (seed_id, url, pos) → seed_id, pos, url, selectable, reason.

    Order of the steps matters: list limit, path scope, language variants, robots. URLs beyond
    `max_list` per seed come back as not selectable, with reason `over_limit`.
    """
    marked = over_limit(found, max_list)
    listed = scope_filter(marked.filter("NOT over_limit").drop("over_limit"))
    checked = selectable_verdict(language_dedupe(listed, ["seed_id"]), seeds, policy)
    if max_list is None:
        return checked
    beyond = marked.filter("over_limit").select(
        *[F.lit(False).alias(c) if c == "selectable" else F.lit("over_limit").alias(c) if c == "reason" else F.col(c)
          for c in checked.columns])
    return checked.unionByName(beyond)


def discover_urls(seeds: DataFrame, sitemaps: DataFrame, responses: DataFrame, edges: DataFrame,
                  policy: DataFrame, max_list: int | None = None, crawl_pages: int | None = None) -> DataFrame:
    """discovery_mode() and checked_urls(). `max_list` limits what is selectable, with a reason."""
    found = discovery_mode(seeds, sitemaps, responses, edges, None, crawl_pages)
    return checked_urls(found.select("seed_id", "url", "pos"), seeds, policy, max_list)
