"""Joins between URLs, start URLs and resolved addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BLOCKED_HOST_SUFFIX, BLOCKED_HOSTS, PRIVATE_HOST_PREFIXES
from ..functions.addresses import closed_address
from ..functions.text import strip
from ..functions.urls import (
    bare_host,
    host_of,
    host_of_netloc,
    netloc_of,
    normalized_url,
    query_of,
    raw_path_of,
    scheme_of,
    site_key,
    split_params,
)
from .networks import closed_by_networks


def host_suffixes(host: Column) -> Column:
    """Every dot suffix of a host, itself included: a.b.c → a.b.c, b.c, c."""
    labels = F.split(host, "\\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def same_site_join(urls: DataFrame, seeds: DataFrame) -> DataFrame:
    """url × seed where the URL belongs to the seed's site: (urls columns, seed_id).

    `urls` has `url`, `seeds` has (seed_id, host). The suffixes are taken from the distinct
    hosts, not from the URLs, so a short suffix such as a top-level domain never carries the
    URL rows themselves. Both joins are equi joins.
    """
    keyed = urls.withColumn("_host", host_of(F.col("url")))
    keys = seeds.select("seed_id", bare_host(F.col("host")).alias("_key")).filter("_key <> ''")
    matches = (
        keyed.select("_host").filter("_host <> ''").distinct()
        .select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_key"))
        .join(keys, "_key").select("_host", "seed_id").distinct()
    )
    return keyed.join(matches, "_host").select(*urls.columns, "seed_id")


def host_verdicts(host_ips: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """host → `closed`: true when any of its addresses is not public. Aggregated per host
    before any join. With `networks` (network, closed) that table decides about an address, not
    the fixed ranges; add fixed_networks() to it to keep those."""
    if networks is None:
        judged = host_ips.select("host", closed_address(F.col("ip")).alias("_closed"))
    else:
        verdicts = closed_by_networks(host_ips, networks).withColumnsRenamed({"ip": "_ip", "closed": "_closed"})
        judged = host_ips.select("host", "ip").join(verdicts, F.col("ip").eqNullSafe(F.col("_ip")))
    return judged.groupBy("host").agg(F.bool_or("_closed").alias("closed"))


def public_ip_join(hosts: DataFrame, host_ips: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """hosts (host) → `resolved`, `public`. Hosts without an address are not public."""
    return hosts.join(host_verdicts(host_ips, networks), "host", "left").select(
        *hosts.columns,
        F.col("closed").isNotNull().alias("resolved"),
        (~F.coalesce("closed", F.lit(True))).alias("public"),
    )


def unsafe_host(host: Column) -> Column:
    """Reason code for a host that is refused by name, else NULL."""
    private = host.startswith(PRIVATE_HOST_PREFIXES[0])
    for prefix in PRIVATE_HOST_PREFIXES[1:]:
        private = private | host.startswith(prefix)
    return F.when(
        host.isin(*BLOCKED_HOSTS) | host.endswith(BLOCKED_HOST_SUFFIX), "blocked_host"
    ).when(private, "private_address")


def unsafe_url(url: Column) -> Column:
    """First failing test on the URL text: scheme, authority, host, host name; else NULL."""
    netloc = netloc_of(url)
    host = host_of_netloc(netloc)
    return (
        F.when(~scheme_of(url).isin("http", "https"), "bad_scheme")
        .when(netloc == "", "no_authority")
        .when(host == "", "no_host")
        .otherwise(unsafe_host(host))
    )


def seed_safety(seeds: DataFrame, host_ips: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """seeds (…, url) → normalised url, host, site_key and the first failing safety test.

    `reason` is NULL for a safe seed; only safe seeds have `base_url`.
    """
    text = strip(F.col("url"))
    path, params = split_params(raw_path_of(text))
    checked = seeds.withColumns({
        "host": host_of(text),
        "_name_reason": unsafe_url(text),
        "_base": normalized_url(scheme_of(text), netloc_of(text), path, params, query_of(text)),
    })
    reason = F.coalesce(
        F.col("_name_reason"),
        F.when(F.col("closed").isNull(), "unresolved"),
        F.when(F.col("closed"), "closed_network"),
    )
    return (
        checked.join(host_verdicts(host_ips, networks), "host", "left")
        .withColumn("reason", reason)
        .select(
            *seeds.columns, "host",
            site_key(F.col("host"), F.col("url")).alias("site_key"),
            F.when(F.col("reason").isNull(), F.col("_base")).alias("base_url"), "reason")
    )
