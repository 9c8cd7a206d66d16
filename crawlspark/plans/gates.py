"""What stands before both flows: typed address, safety of the seed, daily quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DAILY_SITES
from ..functions.urls import seed_url
from ..operators.quota import quota_decisions
from ..operators.sites import seed_safety
from ..session import cut_lineage
from .discover import discover_urls
from .export import export_pages


def gated_seeds(asked: DataFrame, host_ips: DataFrame, op: str, limit: int = DAILY_SITES) -> DataFrame:
    """asked (seed_id, raw, ts, …) → url, host, reason besides; `reason` is NULL for seeds that go on.

    Steps in order, the first that fails decides: the typed address becomes a URL (`no_address`), the
    URL and its host's addresses are safe (codes of seed_safety), the site has a slot that day. A site
    asked for again is `already` refused for the operation `discover`; `scrape` may continue it. Only
    seeds that are safe take a slot.
    """
    kept = [c for c in asked.columns if c not in ("raw", "url", "host", "reason")]
    typed = asked.select(*kept, seed_url(F.col("raw")).alias("url"))
    tested = seed_safety(typed, host_ips)
    checked = cut_lineage(tested.select(
        *kept, F.coalesce("base_url", "url").alias("url"), "host",
        F.when(F.col("url").isNull(), "no_address").otherwise(F.col("reason")).alias("reason")))
    requests = checked.filter("reason IS NULL").select(F.col("seed_id").alias("event_id"), "ts", "url", F.lit(op).alias("op"))
    refused = quota_decisions(requests, limit).filter(
        F.col("decision").isin(*(("already", "limit") if op == "discover" else ("limit",)))).select(
        F.col("event_id").alias("seed_id"), F.col("decision").alias("_quota"))
    return checked.join(refused, "seed_id", "left").withColumn("reason", F.coalesce("reason", "_quota")).drop("_quota")


def _split(asked: DataFrame, host_ips: DataFrame, op: str, limit: int) -> tuple[DataFrame, DataFrame]:
    gated = cut_lineage(gated_seeds(asked, host_ips, op, limit))
    return gated.filter("reason IS NULL").drop("reason"), gated.filter("reason IS NOT NULL")


def discover_gated(asked: DataFrame, host_ips: DataFrame, sitemaps: DataFrame, responses: DataFrame, edges: DataFrame,
                   policy: DataFrame, limit: int = DAILY_SITES, **limits) -> DataFrame:
    """discover_urls() for the seeds that pass; each refused seed is one row with its reason, at pos 0."""
    seeds, refused = _split(asked, host_ips, "discover", limit)
    found = discover_urls(seeds, sitemaps, responses, edges, policy, **limits)
    return found.unionByName(refused.select(
        "seed_id", F.lit(0).cast("bigint").alias("pos"), "url", F.lit(False).alias("selectable"), "reason"))


def export_gated(asked: DataFrame, host_ips: DataFrame, requests: DataFrame, policy: DataFrame, responses: DataFrame,
                 bodies: DataFrame, limit: int = DAILY_SITES, **limits) -> DataFrame:
    """export_pages() for requests of seeds that pass; each refused seed is one row with its reason, at pos 0."""
    seeds, refused = _split(asked, host_ips, "scrape", limit)
    rows = export_pages(requests.join(seeds.select("seed_id"), "seed_id", "left_semi"), seeds, policy, responses, bodies, **limits)
    return rows.unionByName(refused.select(
        "seed_id", F.lit(0).cast("bigint").alias("pos"), "url", F.col("reason").alias("error")), allowMissingColumns=True)
