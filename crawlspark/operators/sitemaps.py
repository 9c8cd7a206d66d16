"""Sitemaps: locations of one document, and the expansion from index to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import built_once
from ..functions.text import decode_references, strip
from ..functions.urls import host_of, same_site, scheme_of
from ..session import cut_lineage, measured, rows_for_keys
from .ordering import sums_before

# One document has at most as many locations as an array.
ARRAY_ITEMS = (1 << 31) - 16
# documents of one seed that a window takes; the locations of more are summed along a range sort
WINDOW_DOCUMENTS = 5000


def _without_comments(xml: Column) -> Column:
    return F.when(xml.contains("<!--"), F.regexp_replace(xml, "(?s)<!--.*?(?:-->|\\z)", "")).otherwise(xml)


def is_index(xml: Column) -> Column:
    return F.regexp_extract(xml, "<(sitemapindex|urlset)(?=[\\s/>])", 1) == "sitemapindex"


def locations(xml: Column) -> Column:
    """Trimmed, decoded, non-empty `loc` texts in document order. Broken XML just ends early."""
    raw = F.regexp_extract_all(xml, F.lit("(?s)<loc(?:\\s[^>]*+)?>(.*?)</loc\\s*+>"), F.lit(1))

    def text(loc: Column) -> Column:
        plain = F.regexp_replace(
            F.regexp_replace(loc, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1"), "</?[A-Za-z][^>]*+>", "")
        return strip(decode_references(plain))

    return F.array_remove(F.transform(raw, text), "")


@built_once
def _all_locations() -> Column:
    return locations(F.col("_xml"))


@built_once
def _listed_pages() -> Column:
    return F.slice(
        F.filter("locs", lambda u: page_loc(u, F.col("host"))), F.lit(1),
        F.least("max_urls", F.lit(ARRAY_ITEMS)).cast("int"))  # the least of a NULL and a number is the number


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """sitemap_url, is_index, locs ARRAY. A urlset lists a location once, an index as often as
    it is written."""
    parsed = sitemaps.select("sitemap_url", _without_comments(F.col("xml")).alias("_xml")).select(
        "sitemap_url", is_index(F.col("_xml")).alias("is_index"), _all_locations().alias("_all"))
    return parsed.select(
        "sitemap_url", "is_index",
        F.when(F.col("is_index"), F.col("_all")).otherwise(F.array_distinct("_all")).alias("locs"))


def all_loc_rows(sitemaps: DataFrame) -> DataFrame:
    """sitemap_url, is_index, pos, loc as written, repeats included."""
    plain = sitemaps.select("sitemap_url", _without_comments(F.col("xml")).alias("_xml"))
    return plain.select(
        "sitemap_url", is_index(F.col("_xml")).alias("is_index"),
        F.posexplode(_all_locations()).alias("pos", "loc"))


def loc_rows(sitemaps: DataFrame) -> DataFrame:
    """sitemap_url, is_index, pos, loc: one row per location."""
    return sitemap_locs(sitemaps).select(
        "sitemap_url", "is_index", F.posexplode("locs").alias("pos", "loc"))


def page_loc(loc: Column, host: Column) -> Column:
    """A location that lists a page of the seed's site."""
    return scheme_of(loc).isin("http", "https") & same_site(host_of(loc), host)


def sitemap_loc_filter(locs: DataFrame, host: Column) -> DataFrame:
    return locs.filter(page_loc(F.col("loc"), host))


def sitemap_expand(starts: DataFrame, sitemaps: DataFrame, group: list[str]) -> DataFrame:
    """starts (group…, sitemap_url, host, max_urls) → group…, url, pos.

    Breadth first from each start; every sitemap is read once per group, missing ones are
    skipped. The first `max_urls` page locations in reading order count, then repeats are
    removed; a NULL `max_urls` is no limit. A table holds finitely many sitemaps and each is read
    once per group, so indexes may nest to any depth. Reading order is (level, path of positions in the indexes, position in the
    document), so no rank is needed until the cap: documents are capped by their counts, and
    only documents that start below the cap are unfolded.
    """
    documents = sitemap_locs(sitemaps)
    pages = _listed_pages()
    dims = ["host", "max_urls"]
    starts = starts.withColumn("max_urls", F.col("max_urls").cast("bigint"))
    candidates = starts.select(*group, *dims, "sitemap_url", F.array(F.lit(0).cast("bigint")).alias("path"))
    seen: DataFrame | None = None
    urlsets: list[DataFrame] = []
    level = 0
    while True:
        candidates = cut_lineage(candidates)
        n_asked, asked_bytes = measured(candidates, "sitemap_url")
        if n_asked == 0:
            break
        # the semi join moves below the parsing: only documents asked for are parsed
        asked_for = rows_for_keys(documents, candidates, "sitemap_url", asked_bytes)
        read = candidates.join(asked_for, "sitemap_url", "left").select(
            *group, *dims, "sitemap_url", "path", "is_index",
            F.when(F.col("is_index"), F.col("locs")).otherwise(pages).alias("locs"))
        read = cut_lineage(read)
        asked = read.select(*group, "sitemap_url")
        seen = asked if seen is None else seen.unionByName(asked)
        urlsets.append(read.filter("NOT is_index AND size(locs) > 0").select(
            *group, "max_urls", F.lit(level).alias("level"), "path", "locs"))
        children = (
            read.filter("is_index")
            .select(*group, *dims, "path", F.posexplode("locs").alias("loc_pos", "child"))
            .groupBy(*group, F.col("child").alias("sitemap_url"))
            .agg(F.min(F.array_append("path", F.col("loc_pos").cast("bigint"))).alias("path"),
                 *[F.first(c).alias(c) for c in dims])
        )
        full = (
            _union(urlsets).groupBy(*group)
            .agg(F.sum(F.size("locs")).alias("_n"), F.max("max_urls").alias("_cap"))
            .filter("_n >= _cap").select(*group)
        )
        candidates = (
            children.join(full, group, "left_anti")
            .join(seen, [*group, "sitemap_url"], "left_anti")
            .select(*group, *dims, "sitemap_url", "path")
        )
        level += 1

    if not urlsets:
        return candidates.select(
            *group, F.col("sitemap_url").alias("url"), F.lit(0).cast("bigint").alias("pos"))
    found = _union(urlsets)
    order = ["level", "path"]
    counts = found.select(*group, *order, "max_urls", F.size("locs").alias("_n"))
    most = counts.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= WINDOW_DOCUMENTS:
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        placed = sums_before(counts, group, order, F.col("_n"))
    offsets = (
        placed.filter(F.col("max_urls").isNull() | (F.col("before") < F.col("max_urls")))
        .select(*group, *order, F.col("before").alias("_before"))
    )
    return (
        found.join(offsets, [*group, *order])
        .select(*group, "_before", F.posexplode(F.slice(
            "locs", F.lit(1), F.least(F.col("max_urls") - F.col("_before"), F.size("locs")).cast("int"))).alias("_i", "url"))
        .groupBy(*group, "url").agg(F.min(F.col("_before") + F.col("_i") + 1).cast("bigint").alias("pos"))
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
