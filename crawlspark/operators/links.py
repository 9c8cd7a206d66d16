"""Links of pages: extraction, resolution, filtering and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import IGNORED_LINK_PREFIXES, ROBOTS_PATH
from ..functions.html import anchor_hrefs, resolved_link
from ..functions.staging import built_once, stage
from ..functions.urls import host_of, same_site, scheme_of


@built_once
def _hrefs() -> Column:
    return anchor_hrefs(F.col("html"))


@built_once
def _target() -> Column:
    return F.when(_followable(F.col("href")), resolved_link(F.col("url"), F.col("href")))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, link_pos, href: anchors in document order. The body stops here."""
    return pages.select("page_id", "url", F.posexplode(_hrefs()).alias("link_pos", "href"))


def _followable(href: Column) -> Column:
    ok = href != ""
    for prefix in IGNORED_LINK_PREFIXES:
        ok = ok & ~href.startswith(prefix)
    return ok


def resolve_links(links: DataFrame) -> DataFrame:
    """Add `dst`, the absolute target without fragment; NULL for hrefs never followed."""
    return stage(links, dst=_target())


def web_target(dst: Column) -> Column:
    """http(s), not a robots file."""
    return dst.isNotNull() & scheme_of(dst).isin("http", "https") & ~dst.endswith(ROBOTS_PATH)


def link_filter(links: DataFrame, seed_host: Column) -> DataFrame:
    """Resolved links that a crawl of `seed_host` would follow."""
    return links.filter(web_target(F.col("dst")) & same_site(host_of(F.col("dst")), seed_host))


def page_address(url: Column) -> Column:
    """The URL a page is requested under: its fragment is never sent."""
    return F.substring_index(url, "#", 1)


def link_edges(pages: DataFrame) -> DataFrame:
    """src_id, src, link_pos, dst for every followable link, whatever its host."""
    resolved = resolve_links(page_links(pages)).filter(web_target(F.col("dst")))
    return resolved.select(
        F.col("page_id").alias("src_id"), page_address(F.col("url")).alias("src"), "link_pos", "dst")


def link_graph(pages: DataFrame) -> DataFrame:
    """Edges between known pages: src_id, link_pos, dst, dst_id.

    A popular target makes its join key hot on the edge side only; the page side has one row
    per address, so the skewed partition is split at run time.
    """
    known = pages.select(page_address(F.col("url")).alias("dst"), "page_id") \
        .groupBy("dst").agg(F.min("page_id").alias("dst_id"))
    return link_edges(pages).join(known, "dst").select("src_id", "link_pos", "dst", "dst_id")


def dangling_targets(pages: DataFrame) -> DataFrame:
    """Targets no page answers to, with the number of links to each.

    Counted before the anti join: a popular target is one row by then.
    """
    known = pages.select(page_address(F.col("url")).alias("dst"))
    return (
        link_edges(pages).groupBy("dst").agg(F.count("*").alias("n_links"))
        .join(known, "dst", "left_anti")
    )
