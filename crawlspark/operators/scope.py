"""Path scope: which URLs are customer-facing, by their first path segment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ALLOWED_SEGMENTS, EXCLUDED_SEGMENTS
from ..functions.urls import first_segment, raw_path_of, readable_url


def scope_rules(spark: SparkSession, exclude: Iterable[str] = EXCLUDED_SEGMENTS,
                allow: Iterable[str] = ALLOWED_SEGMENTS) -> DataFrame:
    """Rule table: excluded segments minus allowed ones."""
    def table(words: Iterable[str]) -> DataFrame:
        return spark.createDataFrame([(w,) for w in words], "segment string")

    return table(exclude).exceptAll(table(allow))


def scope_segment(url: Column) -> Column:
    return F.lower(first_segment(raw_path_of(readable_url(url))))


def in_scope(url: Column, exclude: Iterable[str] = EXCLUDED_SEGMENTS,
             allow: Iterable[str] = ALLOWED_SEGMENTS) -> Column:
    """True unless the first segment is excluded. The list is a literal set in the plan, so
    the test stays inside the scan stage: no join, no exchange."""
    allowed = set(allow)
    return ~scope_segment(url).isin(*[w for w in exclude if w not in allowed])


def scope_filter(urls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Keep in-scope URLs. A rule table of any size may be given instead of the fixed list."""
    if rules is None:
        return urls.filter(in_scope(F.col("url")))
    return (
        urls.withColumn("segment", scope_segment(F.col("url")))
        .join(rules.select("segment").distinct(), "segment", "left_anti")
        .select(*urls.columns)
    )


def scope_verdict(urls: DataFrame) -> DataFrame:
    """Keep all rows and add `allowed` and `reason`."""
    allowed = in_scope(F.col("url"))
    return urls.withColumns({
        "allowed": allowed, "reason": F.when(allowed, "").otherwise("excluded_path")})


def scope_rule_usage(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with the number of URLs it drops, unused rules included."""
    hits = (
        urls.select(scope_segment(F.col("url")).alias("segment"))
        .groupBy("segment").agg(F.count("*").alias("n_urls"))
    )
    return rules.join(hits, "segment", "left").select(
        "segment", F.coalesce("n_urls", F.lit(0)).cast("bigint").alias("n_urls"))
