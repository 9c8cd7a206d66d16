"""Duplicate removal: exact repeats, repeated locations and language variants.

All of them are aggregations with map-side partials (`min`, `min` of a struct), so a hot key
shrinks to one row per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import with_language_key


def first_occurrence(urls: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Exact duplicates removed per group; the first position stays."""
    keys = [*(group or []), "url"]
    return urls.groupBy(*keys).agg(F.min("pos").alias("pos"))


def loc_distinct(locs: DataFrame) -> DataFrame:
    """(sitemap_url, is_index, pos, loc): a urlset keeps the first of equal locations, an
    index keeps all."""
    slot = F.when(F.col("is_index"), F.col("pos")).otherwise(F.lit(-1))
    return (
        locs.groupBy("sitemap_url", "is_index", "loc", slot.alias("_slot"))
        .agg(F.min("pos").alias("pos"))
        .select("sitemap_url", "is_index", "pos", "loc")
    )


def language_dedupe(urls: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One URL per page key: best (language rank, url), at the position of the first variant."""
    group = group or []
    return (
        with_language_key(urls)
        .groupBy(*group, "page_key")
        .agg(
            F.min(F.struct("lang_rank", "url")).alias("_best"),
            F.min("pos").alias("pos"),
        )
        .select(*group, "pos", F.col("_best.url").alias("url"))
    )


def language_groups(urls: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Page keys with their number of variants and the languages seen.

    The members themselves are the rows of `with_language_key`; they are not collected, as one
    group may hold any number of URLs. Distinct languages are few by construction.
    """
    group = group or []
    return (
        with_language_key(urls)
        .groupBy(*group, "page_key")
        .agg(
            F.count("*").alias("n_variants"),
            F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"),
            F.min(F.struct("lang_rank", "url")).alias("_best"),
            F.min("pos").alias("pos"),
        )
        .select(*group, "page_key", "n_variants", "langs", F.col("_best.url").alias("url"), "pos")
    )
