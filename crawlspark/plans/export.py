"""From requested URLs to title, text or error, and the JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_DOCUMENT_NAME, MAX_BODY_BYTES, MAX_EXPORT_BATCH
from ..functions.html import (
    boilerplate_chunks,
    boilerplate_mask,
    landmarks,
    main_block,
    outside_boilerplate,
    page_nodes,
    page_text,
    page_title,
    without_raw_text,
)
from ..functions.staging import built_once
from ..functions.urls import bare_host, host_of, same_site
from ..operators.dedupe import language_dedupe
from ..operators.links import page_address
from ..operators.progress import over_limit
from ..operators.robots import robots_allowed, seed_policies
from ..operators.scope import in_scope
from ..session import BROADCAST_BYTES, cut_lineage, measured, rows_for_keys

# column a body store is bucketed by
BODY_KEY = "address"


@built_once
def _text_stages(html: str) -> list[tuple[str, Column]]:
    """Columns added one after the other, each from the one before."""
    pieces, block = F.col("_pieces"), F.col("_block")
    return [
        ("_chunks", boilerplate_chunks(without_raw_text(F.col(html)))),
        ("_mask", boilerplate_mask(F.col("_chunks"))),
        ("_pieces", landmarks(outside_boilerplate(F.col("_chunks"), F.col("_mask")))),
        ("_block", main_block(pieces)),
        ("_nodes", page_nodes(pieces, block)),
    ]


@built_once
def _text_results() -> list[Column]:
    nodes = F.col("_nodes")
    return [page_title(nodes).alias("title"), page_text(nodes).alias("text")]


def with_text_and_title(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the body by `title` and `text`, in stages so that each cut runs once."""
    kept = [c for c in pages.columns if c != html]
    for name, column in _text_stages(html):
        pages = pages.withColumn(name, column)
    return pages.select(*kept, *_text_results())


def before_fetch(url: Column, seed_host: Column, status: Column, rules: Column) -> Column:
    """Reason a URL is not fetched, or NULL: other site, excluded path, robots."""
    return (
        F.when(~same_site(host_of(url), seed_host), "other_host")
        .when(~in_scope(url), "excluded_path")
        .when(~robots_allowed(url, status, rules), "robots")
    )


def after_fetch(fetch_error: Column, status: Column, n_bytes: Column, content_type: Column,
                max_body_bytes: int | None = MAX_BODY_BYTES) -> Column:
    """Reason a response gives no text, or NULL. `max_body_bytes` None takes bodies of any size."""
    too_large = F.lit(False) if max_body_bytes is None else n_bytes > max_body_bytes
    return (
        F.when(fetch_error.isNotNull(), fetch_error)
        .when(status.isNull(), "no_response")
        .when(status.isin(401, 403), "not_public")
        .when(~status.between(200, 299), F.concat(F.lit("http_"), status.cast("string")))
        .when(too_large, "too_large")
        .when(~F.lower(F.coalesce(content_type, F.lit(""))).contains("html"), "not_html")
    )


def fetch_verdict(requests: DataFrame, seeds: DataFrame, policy: DataFrame,
                  responses: DataFrame, max_body_bytes: int | None = MAX_BODY_BYTES) -> DataFrame:
    """requests (seed_id, pos, url) → final_url, error (NULL when the page has text).

    `responses` has one row per url: status, content_type, n_bytes and, optionally, final_url
    and fetch_error. The tests run in order and stop at the first that fails.
    """
    def column(name: str, default: Column) -> Column:
        return F.col(name) if name in responses.columns else default

    answers = responses.select(
        "url", "status", "content_type", "n_bytes",
        column("final_url", F.col("url")).alias("_final"),
        column("fetch_error", F.lit(None).cast("string")).alias("_failed"))
    c = F.col
    return (
        requests.join(seed_policies(seeds, policy), "seed_id")
        .withColumn("_early", before_fetch(c("url"), c("seed_host"), c("robots_status"), c("rules")))
        .join(answers, "url", "left")
        .withColumn("error", F.coalesce(
            c("_early"), after_fetch(c("_failed"), c("status"), c("n_bytes"), c("content_type"), max_body_bytes)))
        .select(
            *requests.columns,
            F.when(c("error").isNull(), c("_final")).otherwise(c("url")).alias("final_url"), "error")
    )


def write_body_store(bodies: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Bodies (url, html) as a table bucketed by the address they are asked for, and that table.

    texts_of() meets it bucket by bucket: requests are shuffled to the buckets, bodies stay where they
    are, whatever the number of requests. `buckets` should give files of some hundred megabytes; `path`
    is a folder outside the warehouse.
    """
    stored = bodies.select(page_address(F.col("url")).alias(BODY_KEY), "url", "html")
    # one task a bucket: else every task writes a file into every bucket
    writer = stored.repartition(buckets, BODY_KEY).write.bucketBy(buckets, BODY_KEY).sortBy(BODY_KEY)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return bodies.sparkSession.table(table)


def texts_of(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """_key, title, text of the bodies (url, html) whose address occurs in `wanted` (_key).

    Bodies never move: wanted addresses are broadcast to the scan if they measure small enough, and
    the text is extracted in the scan stage. If they do not, a body store (write_body_store) is joined
    by its buckets and only wanted bodies are read for text; bodies without such a store are all
    read for text. Only titles and texts are shuffled. Of several bodies with one address the one with
    the smallest url holds.
    """
    stored = BODY_KEY in bodies.columns
    address = F.col(BODY_KEY) if stored else page_address(F.col("url"))
    keyed = bodies.select("url", "html", address.alias("_key"))
    _, key_bytes = measured(wanted, "_key")
    if key_bytes <= BROADCAST_BYTES:
        keyed = rows_for_keys(keyed, wanted, "_key", key_bytes)
    elif stored:
        # dealt out evenly, else Spark might shuffle the bodies to the partitions of the distinct step
        keyed = keyed.join(wanted.select("_key").distinct().hint("rebalance"), "_key", "left_semi")
    return with_text_and_title(keyed).groupBy("_key").agg(F.min_by(F.struct("title", "text"), "url").alias("t")).select(
        "_key", "t.title", "t.text")


def spread_key(key: Column) -> Column:
    """Refused rows, without an address, have keys of their own, so that they spread evenly over a join."""
    return F.coalesce(key, F.concat_ws(" ", F.lit("refused"), F.col("seed_id"), F.col("pos")))


def export_rows(verdicts: DataFrame, bodies: DataFrame) -> DataFrame:
    """seed_id, pos, url (final), title, text, error, requested_url.

    `bodies` (url, html) is looked up by the final address, without its fragment.
    """
    # the verdicts are read for the wanted addresses and for the rows
    keyed = cut_lineage(verdicts.withColumn("_key", F.when(F.col("error").isNull(), page_address(F.col("final_url")))))
    texts = texts_of(bodies, keyed.filter("_key IS NOT NULL").select("_key"))
    found = texts.withColumn("_found", F.lit(True))
    ok = F.col("error").isNull()
    return (
        keyed.withColumn("_key", spread_key(F.col("_key"))).join(found, "_key", "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("_found").isNull(), "no_response")))
        .select("seed_id", "pos", F.col("final_url").alias("url"), F.when(ok, F.col("title")).alias("title"),
                F.when(ok, F.col("text")).alias("text"), "error", F.col("url").alias("requested_url"))
    )


def export_pages(requests: DataFrame, seeds: DataFrame, policy: DataFrame, responses: DataFrame,
                 bodies: DataFrame, max_batch: int | None = None) -> DataFrame:
    """Requested URLs → language variants collapsed → verdicts → titles and texts.

    Requests beyond `max_batch` per seed come back with the error `over_limit`.
    """
    marked = over_limit(requests, max_batch)
    wanted = language_dedupe(marked.filter("NOT over_limit").drop("over_limit"), ["seed_id"])
    verdicts = fetch_verdict(wanted, seeds, policy, responses)
    if max_batch is not None:
        verdicts = verdicts.unionByName(marked.filter("over_limit").select(
            *wanted.columns, F.col("url").alias("final_url"), F.lit("over_limit").alias("error")))
    return export_rows(verdicts, bodies)


# ------------------------------------------------------------------------------ sinks


def page_object() -> Column:
    """What a page's line says; absent parts are left out of the JSON."""
    return F.struct("base_url", F.col("pos").alias("index"), "requested_url", "url", "title", "text", "error")


def ndjson_lines(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_id, pos, line: one JSON object per page, with the seed's address, the place in the
    request list and the requested URL, so that lines of several sites can share a folder."""
    based = rows.join(seeds.select("seed_id", F.col("url").alias("base_url")), "seed_id", "left")
    return based.select("seed_id", "pos", F.to_json(page_object(), {"ignoreNullFields": "true"}).alias("line"))


def export_part(pos: Column, part_rows: int = MAX_EXPORT_BATCH) -> Column:
    """Part a position falls into: blocks of `part_rows` positions. No row is left out."""
    return F.floor(pos / part_rows).cast("bigint")


def write_ndjson(rows: DataFrame, seeds: DataFrame, path: str) -> None:
    """One object per line; the lines of a part lie together and in request order.

    Hash partitions by (seed, part): a large seed spreads over many files, and no sampling
    pass runs the text work a second time, as a range partitioning would.
    """
    part = export_part(F.col("pos"))
    (
        ndjson_lines(rows, seeds).withColumn("part", part).repartition("seed_id", "part")
        .sortWithinPartitions("seed_id", "part", "pos").select("line")
        .write.mode("overwrite").text(path)
    )


def document_name(base_url: Column) -> Column:
    """First label of the host, letters, digits, `_` and `-` only."""
    label = F.regexp_replace(F.substring_index(bare_host(host_of(base_url)), ".", 1), "[^a-z0-9_-]", "")
    return F.coalesce(
        F.nullif(F.regexp_replace(label, "^-+|-+$", ""), F.lit("")), F.lit(DEFAULT_DOCUMENT_NAME))


def site_documents(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """name, base_url, part, pages ARRAY<STRUCT<pos, url, title, text, error>> per seed.

    A document covers one export batch: `part` counts blocks of positions of that size, so an
    array never outgrows a batch, however many pages a site has.
    """
    gathered = rows.groupBy("seed_id", export_part(F.col("pos")).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "url", "title", "text", "error"))).alias("pages"))
    return gathered.join(seeds.select("seed_id", F.col("url").alias("base_url")), "seed_id").select(
        document_name(F.col("base_url")).alias("name"), "base_url", "part", "pages")


def write_site_documents(rows: DataFrame, seeds: DataFrame, path: str) -> None:
    """JSON documents in one folder per name."""
    (
        site_documents(rows, seeds)
        .withColumn("pages", F.transform(
            "pages", lambda p: F.struct(p["url"], p["title"], p["text"], p["error"])))
        .write.mode("overwrite").option("ignoreNullFields", "true").partitionBy("name").json(path)
    )
