"""Registered jobs: name → callable(spark, sf_dir) → DataFrame.

Each entry runs a library job over the whole given tables, or over inputs derived from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import derived
from crawlspark.functions.urls import (
    host_of,
    normalized_url,
    origin_of,
    seed_url,
    segments,
    site_key,
    with_language_key,
    with_url_parts,
)
from crawlspark.operators import dedupe, fetch, links, progress, quota, robots, scope, sitemaps, sites
from crawlspark.operators.crawl import crawl_frontier
from crawlspark.plans import discover, export, gates
from crawlspark.session import configure, scratch_path
from crawlspark.sources import tables
from crawlspark.streaming import export as export_stream
from crawlspark.streaming import quota as quota_stream

AGENT = "examplebot/1.0"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def claims_of(events):
    """Request events (event_id, ts, url, op) of the given event table or stream, all types."""
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "signup"), "discover").when(kind.isin("click", "purchase"), "scrape").otherwise("check")
    url = F.concat(F.lit("https://www.site"), F.col("user_id").cast("string"), F.lit(".example.com/"))
    return events.select("event_id", "ts", url.alias("url"), op.alias("op"))


def _pages(spark, d, with_html=False):
    return tables.scan_pages(spark, f"{d}/pages.parquet", with_html)


def _stored(spark, d, name):
    """A derived input as a table on disk, as crawl tables are; the loop jobs read it per level."""
    path = scratch_path(spark, name)
    derived(spark, d, name).write.parquet(path)
    return spark.read.parquet(path)


def _dated(df):
    """Days as text, the one spelling both engines share."""
    return df.withColumn("day", F.col("day").cast("string"))


# ------------------------------------------------------------------------ sources, sinks


@_query
def scan_pages(spark, d):
    return _pages(spark, d, True)


@_query
def scan_fetch_log(spark, d):
    return tables.attempts(derived(spark, d, "fetch_log")).select(
        "url", "attempt", "status", "content_type", "n_bytes")


@_query
def scan_robots(spark, d):
    return tables.robots_lines(derived(spark, d, "robots_txt")).select(
        "site", F.col("line_no").cast("bigint").alias("line_no"), "line")


@_query
def scan_sitemaps(spark, d):
    guesses = tables.with_sitemap_guesses(derived(spark, d, "seeds"))
    return guesses.join(derived(spark, d, "sitemaps"), "sitemap_url").select(
        "seed_id", F.col("guess").cast("bigint").alias("guess"), "sitemap_url", "xml")


@_query
def scan_claim_events(spark, d):
    return tables.claim_events(derived(spark, d, "claim_events"))


@_query
def export_ndjson(spark, d):
    path = scratch_path(spark, "ndjson")
    export.write_ndjson(_exported(spark, d), derived(spark, d, "seeds"), path)
    return spark.read.schema(
        "base_url string, index bigint, requested_url string, url string, title string, text string, error string").json(path)


@_query
def export_site_documents(spark, d):
    path = scratch_path(spark, "documents")
    export.write_site_documents(_exported(spark, d), derived(spark, d, "seeds"), path)
    page = "array<struct<url:string,title:string,text:string,error:string>>"
    return (
        spark.read.schema(f"base_url string, part bigint, pages {page}, name string").json(path)
        .select("name", "base_url", "part", F.posexplode("pages").alias("i", "page"))
        .select("name", "base_url", "part", F.col("i").cast("bigint").alias("i"), "page.*")
    )


# --------------------------------------------------------------------------- URL columns


@_query
def url_parts(spark, d):
    return with_url_parts(_pages(spark, d)).select(
        "page_id", "scheme", "netloc", "host", "path", "params", "query", "fragment")


@_query
def url_normalize(spark, d):
    parts = with_url_parts(derived(spark, d, "seed_urls").withColumn("url", F.btrim("url")))
    return parts.select("seed_id", normalized_url(*[
        F.col(c) for c in ("scheme", "netloc", "path", "params", "query")]).alias("normalized"))


@_query
def site_keys(spark, d):
    return derived(spark, d, "seed_urls").select(
        "seed_id", site_key(host_of(F.col("url")), F.col("url")).alias("site_key"))


@_query
def url_segments(spark, d):
    parts = segments(F.col("path"))
    return with_url_parts(_pages(spark, d)).select(
        "page_id", F.array_join(parts, "|").alias("segments"), F.size(parts).cast("bigint").alias("n"))


@_query
def canonical_url_key(spark, d):
    return with_language_key(derived(spark, d, "language_variants"))


@_query
def seed_normalize(spark, d):
    return derived(spark, d, "typed_addresses").select("page_id", seed_url(F.col("raw")).alias("url"))


# --------------------------------------------------------------------------------- filters


@_query
def scope_filter(spark, d):
    return scope.scope_filter(derived(spark, d, "scope_urls"))


@_query
def scope_verdict(spark, d):
    return scope.scope_verdict(derived(spark, d, "scope_urls"))


@_query
def scope_rules(spark, d):
    return scope.scope_rule_usage(derived(spark, d, "scope_urls"), scope.scope_rules(spark))


@_query
def seed_safety(spark, d):
    return sites.seed_safety(derived(spark, d, "seed_urls"), derived(spark, d, "host_ips"))


@_query
def link_filter(spark, d):
    resolved = links.resolve_links(derived(spark, d, "hrefs"))
    return links.link_filter(resolved, host_of(F.col("url"))).select("page_id", "link_pos", "dst")


@_query
def crawlable_response(spark, d):
    return fetch.crawlable_response(derived(spark, d, "site_responses")).select("url", "final_url")


@_query
def sitemap_loc_filter(spark, d):
    host = F.regexp_extract("sitemap_url", "//([^/]*)", 1)
    return sitemaps.sitemap_loc_filter(
        sitemaps.loc_rows(derived(spark, d, "sitemaps")).filter("NOT is_index"), host
    ).select("sitemap_url", "loc")


def _policy(spark, d):
    return robots.robots_policy(derived(spark, d, "robots_txt"), AGENT)


def _verdicts(spark, d):
    return export.fetch_verdict(
        derived(spark, d, "requests"), derived(spark, d, "seeds"), _policy(spark, d),
        fetch.final_attempt(derived(spark, d, "fetch_log").drop("page_id")))


@_query
def fetch_verdict(spark, d):
    return _verdicts(spark, d)


def _final_answers(spark, d):
    """What each address gives in the end: retries first, then redirects with their safety tests."""
    log = fetch.final_attempt(_stored(spark, d, "hop_log"))
    hosts = sites.host_verdicts(derived(spark, d, "host_ips"))
    return fetch.after_redirects(log.select("url"), log, hosts)


def _redirected_verdicts(spark, d):
    # requests name addresses without fragments, as the log does
    requests = derived(spark, d, "requests").withColumn("url", links.page_address(F.col("url")))
    return export.fetch_verdict(requests, derived(spark, d, "seeds"), _policy(spark, d), _final_answers(spark, d))


@_query
def fetch_verdict_redirects(spark, d):
    return _redirected_verdicts(spark, d)


@_query
def selectable_verdict(spark, d):
    return robots.selectable_verdict(
        derived(spark, d, "requests"), derived(spark, d, "seeds"), _policy(spark, d))


# ----------------------------------------------------------------------------------- joins


@_query
def same_site_join(spark, d):
    return sites.same_site_join(
        _pages(spark, d).select("page_id", "url"), derived(spark, d, "seeds").select("seed_id", "host"))


@_query
def robots_gate(spark, d):
    return robots.robots_gate(
        derived(spark, d, "pg").select("page_id", "url", origin_of(F.col("url")).alias("site")), _policy(spark, d))


@_query
def public_ip_join(spark, d):
    hosts = derived(spark, d, "pg").select("host").distinct()
    return sites.public_ip_join(hosts, derived(spark, d, "host_ips"))


@_query
def public_ip_join_networks(spark, d):
    hosts = derived(spark, d, "page_ips").select("host").distinct()
    return sites.public_ip_join(hosts, derived(spark, d, "page_ips"), derived(spark, d, "networks"))


@_query
def link_graph(spark, d):
    pages = _pages(spark, d, True)
    known = links.link_graph(_linked_pages(pages))
    return known.select("src_id", F.col("link_pos").cast("bigint").alias("link_pos"), "dst", "dst_id")


@_query
def dangling_targets(spark, d):
    return links.dangling_targets(_linked_pages(_pages(spark, d, True)))


def _linked_pages(pages):
    """Pages whose first link points at their own address and last link at a missing page."""
    at = links.page_address(F.col("url"))
    return pages.withColumn("html", F.concat(
        F.lit('<a href="'), F.replace(at, F.lit("&"), F.lit("&amp;")), F.lit('">self</a>'),
        F.col("html"), F.lit("<a href='gone'>x</a>")))


@_query
def crawl_levels(spark, d):
    answers = fetch.crawlable_response(derived(spark, d, "crawl_responses"))
    return crawl_frontier(derived(spark, d, "crawl_seeds"), answers, _stored(spark, d, "edges")).select(
        "seed_id", F.col("depth").cast("bigint").alias("depth"), "pos", "url", "final_url")


def _guessed(spark, d):
    return tables.with_sitemap_guesses(derived(spark, d, "seeds")).select(
        "seed_id", "guess", "sitemap_url", "host", F.col("crawl_max_pages").alias("max_urls"))


@_query
def sitemap_expand(spark, d):
    return sitemaps.sitemap_expand(
        _guessed(spark, d), _stored(spark, d, "sitemaps"), ["seed_id", "guess"]
    ).withColumn("guess", F.col("guess").cast("bigint"))


@_query
def redirect_resolve(spark, d):
    hops = _stored(spark, d, "redirects")
    closed = sites.host_verdicts(derived(spark, d, "host_ips"))
    return fetch.redirect_resolve(hops.select("url"), hops, closed).select(
        "url", "final_url", F.col("hops").cast("bigint").alias("hops"),
        F.col("status").cast("bigint").alias("status"), "outcome")


def _site_tables(spark, d):
    return (
        _stored(spark, d, "sitemaps"),
        fetch.crawlable_response(_stored(spark, d, "site_responses")),
        _stored(spark, d, "site_links"),
    )


@_query
def discovery_fallback(spark, d):
    seeds = derived(spark, d, "seeds").withColumn("max_urls", F.col("crawl_max_pages"))
    return discover.discovery_fallback(seeds, *_site_tables(spark, d))


@_query
def discovery_mode(spark, d):
    return discover.discovery_mode(derived(spark, d, "seeds"), *_site_tables(spark, d))


@_query
def discover_urls(spark, d):
    return discover.discover_urls(derived(spark, d, "seeds"), *_site_tables(spark, d), _policy(spark, d))


@_query
def discover_gated(spark, d):
    return gates.discover_gated(
        derived(spark, d, "asked_seeds"), derived(spark, d, "host_ips"), *_site_tables(spark, d), _policy(spark, d))


# ---------------------------------------------------------------------------- aggregations


@_query
def daily_site_usage(spark, d):
    return _dated(quota.daily_site_usage(derived(spark, d, "claim_events")))


@_query
def selectable_summary(spark, d):
    return progress.selectable_summary(robots.selectable_verdict(
        derived(spark, d, "requests"), derived(spark, d, "seeds"), _policy(spark, d)))


@_query
def export_summary(spark, d):
    return progress.export_summary(_verdicts(spark, d))


@_query
def language_groups(spark, d):
    return dedupe.language_groups(derived(spark, d, "language_variants"))


@_query
def retry_accounting(spark, d):
    return fetch.retry_accounting(derived(spark, d, "fetch_log"))


@_query
def loc_distinct(spark, d):
    rows = sitemaps.all_loc_rows(derived(spark, d, "sitemaps"))
    return dedupe.loc_distinct(rows).withColumn("pos", F.col("pos").cast("bigint"))


# -------------------------------------------------------------------------- windows, order


@_query
def first_occurrence(spark, d):
    return dedupe.first_occurrence(derived(spark, d, "requests"), ["seed_id"])


@_query
def language_dedupe(spark, d):
    return dedupe.language_dedupe(derived(spark, d, "language_variants"))


@_query
def language_dedupe_pages(spark, d):
    return dedupe.language_dedupe(_pages(spark, d))


@_query
def quota_decisions(spark, d):
    return _dated(quota.quota_decisions(derived(spark, d, "claim_events")))


@_query
def final_attempt(spark, d):
    return fetch.final_attempt(derived(spark, d, "fetch_log").drop("page_id")).select(
        "url", F.col("attempt").cast("bigint").alias("attempt"),
        F.col("status").cast("bigint").alias("status"), "content_type",
        F.col("n_bytes").cast("bigint").alias("n_bytes"))


@_query
def export_progress(spark, d):
    return progress.export_progress(_verdicts(spark, d))


@_query
def cap_per_seed(spark, d):
    rows = derived(spark, d, "requests").join(
        derived(spark, d, "seeds").select("seed_id", "crawl_max_pages"), "seed_id")
    return progress.cap_per_seed(rows, F.col("crawl_max_pages")).select("seed_id", "pos", "url")


@_query
def ordered_output(spark, d):
    return progress.ordered_output(_verdicts(spark, d))


@_query
def unseen_sites(spark, d):
    return _dated(quota.unseen_sites(derived(spark, d, "claim_events")))


# ------------------------------------------------------------------------------- documents


def _texts(spark, d):
    return export.with_text_and_title(derived(spark, d, "page_variants"))


@_query
def page_text(spark, d):
    return _texts(spark, d).select("page_id", "url", "text")


@_query
def page_title(spark, d):
    return _texts(spark, d).select("page_id", "url", "title")


@_query
def page_site_text(spark, d):
    host = host_of(F.col("url"))
    return export.with_text_and_title(_pages(spark, d, True).drop("pos")).select(
        "page_id", site_key(host, F.col("url")).alias("site_key"), "title", "text")


@_query
def page_links(spark, d):
    return links.page_links(_pages(spark, d, True)).select(
        "page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "href")


@_query
def resolve_links(spark, d):
    return links.resolve_links(derived(spark, d, "hrefs")).select("page_id", "href", "dst")


@_query
def resolve_page_links(spark, d):
    return links.resolve_links(links.page_links(_pages(spark, d, True))).select(
        "page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "dst")


@_query
def sitemap_locs(spark, d):
    return sitemaps.loc_rows(derived(spark, d, "sitemaps")).withColumn("pos", F.col("pos").cast("bigint"))


@_query
def robots_rules(spark, d):
    return robots.robots_rules(derived(spark, d, "robots_txt"))


def _exported(spark, d, bodies=None):
    return export.export_pages(
        derived(spark, d, "requests"), derived(spark, d, "seeds"), _policy(spark, d),
        fetch.final_attempt(derived(spark, d, "fetch_log").drop("page_id")),
        _pages(spark, d, True) if bodies is None else bodies)


@_query
def export_pages(spark, d):
    return _exported(spark, d)


@_query
def export_pages_stored(spark, d):
    """The export from a body store: bodies lie bucketed by address."""
    name = f"body_store_{uuid.uuid4().hex}"
    store = export.write_body_store(_pages(spark, d, True), name, 8, scratch_path(spark, name))
    return _exported(spark, d, store)


@_query
def export_pages_redirects(spark, d):
    return export.export_rows(_redirected_verdicts(spark, d), _pages(spark, d, True))


@_query
def export_gated(spark, d):
    return gates.export_gated(
        derived(spark, d, "asked_seeds"), derived(spark, d, "host_ips"), derived(spark, d, "requests"), _policy(spark, d),
        fetch.final_attempt(derived(spark, d, "fetch_log").drop("page_id")), _pages(spark, d, True))


# --------------------------------------------------------------------------------- streams


@_query
def quota_decisions_stream(spark, d):
    events = quota_stream.read_events(spark, d, "events.parquet")
    return _dated(quota_stream.run_quota_stream(
        claims_of(events), scratch_path(spark, "quota")))


@_query
def first_claims_stream(spark, d):
    events = quota_stream.read_events(spark, d, "events.parquet")
    return _dated(quota_stream.run_first_claims_stream(
        claims_of(events), scratch_path(spark, "first-claims")))


def _wanted_stream(spark, d):
    """Requests as files that arrive two per batch, and the tables they meet."""
    path = scratch_path(spark, "wanted")
    dedupe.language_dedupe(derived(spark, d, "requests"), ["seed_id"]).select(
        "seed_id", "pos", "url").repartition(6, "pos").write.parquet(path)
    answers = fetch.final_attempt(_stored(spark, d, "fetch_log").drop("page_id"))
    return export_stream.read_requests(spark, path, files_per_batch=2), (derived(spark, d, "seeds"), _policy(spark, d), answers)


@_query
def export_texts_stream(spark, d):
    wanted, tables_ = _wanted_stream(spark, d)
    return export_stream.run_export_stream(wanted, *tables_, _pages(spark, d, True), scratch_path(spark, "export"))


def _timed(rows, column, minute):
    return rows.withColumn(column, F.timestamp_seconds(F.lit(1_700_000_000) + 60 * (F.col(minute) % 60)))


def _joined_streams(spark, d):
    """Requests and pages as files of two streams, out of order within an hour; a last row in each a day later."""
    asked, arrived = scratch_path(spark, "asked"), scratch_path(spark, "arrived")
    requests = _timed(dedupe.language_dedupe(derived(spark, d, "requests"), ["seed_id"]).select("seed_id", "pos", "url"), "asked_at", "pos")
    pages = _timed(_pages(spark, d, True), "arrived_at", "page_id").drop("page_id")
    requests.repartition(6, "pos").write.parquet(asked)
    pages.repartition(4, "url").write.parquet(arrived)
    later = F.timestamp_seconds(F.lit(1_700_000_000 + 86_400))
    end = spark.range(1)
    end.select(F.lit(-1).cast("bigint").alias("seed_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("url"),
               later.alias("asked_at")).write.mode("append").parquet(asked)
    end.select(F.lit("").alias("url"), F.lit("").alias("html"), later.alias("arrived_at")).write.mode("append").parquet(arrived)
    return (export_stream.read_timed_requests(spark, asked, files_per_batch=3),
            export_stream.read_arriving_pages(spark, arrived, files_per_batch=2))


@_query
def export_joined_stream(spark, d):
    requests, pages = _joined_streams(spark, d)
    answers = fetch.final_attempt(_stored(spark, d, "fetch_log").drop("page_id"))
    return export_stream.run_joined_export(
        requests, derived(spark, d, "seeds"), _policy(spark, d), answers, pages, scratch_path(spark, "joined"),
        before="2 hours", wait="2 hours", late="2 hours")


@_query
def progress_stream(spark, d):
    wanted, tables_ = _wanted_stream(spark, d)
    return export_stream.run_progress_stream(wanted, *tables_, scratch_path(spark, "progress"))
