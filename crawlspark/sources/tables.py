"""Crawl tables: schemas and scans.

Every scan names its columns, so parquet reads only those. The page body is read by the text
and link jobs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import SITEMAP_GUESSES

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

SEEDS = T.StructType([
    T.StructField("seed_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("crawl_depth", T.IntegerType()),
    T.StructField("crawl_max_pages", T.IntegerType()),
])

REQUESTS = T.StructType([
    T.StructField("seed_id", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("url", T.StringType()),
])

FETCH_LOG = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("location", T.StringType()),
    T.StructField("fetch_error", T.StringType()),
])

ROBOTS = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

SITEMAPS = T.StructType([
    T.StructField("sitemap_url", T.StringType()),
    T.StructField("xml", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet table at `path`, restricted to `columns` when given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def file_stream(spark: SparkSession, schema: T.StructType, folder: str, names: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they land in `folder`, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", names).parquet(folder)
    )


def scan_pages(spark: SparkSession, path: str, with_html: bool = True) -> DataFrame:
    """Crawled pages; `pos`, the page's place in the list, is its id."""
    if with_html:
        df = scan(spark, path, "page_id", "url", "html")
    else:
        df = scan(spark, path, "page_id", "url")
    return df.withColumn("pos", F.col("page_id"))


def attempts(log: DataFrame) -> DataFrame:
    """One row per fetch attempt, with the declared column types."""
    return log.select(*[
        F.col(f.name).cast(f.dataType) if f.name in log.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in FETCH_LOG.fields
    ])


def robots_lines(robots: DataFrame) -> DataFrame:
    """site, line_no, line: the lines of each readable robots file."""
    lines = F.split("body", "\r\n|[\n\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]")
    return robots.filter(F.col("status").between(200, 299)).select(
        "site", F.posexplode(lines).alias("line_no", "line"))


def sitemap_guesses(base_url: Column) -> Column:
    """Array of (guess, sitemap_url): where a site's sitemap is looked for, in order."""
    root = F.regexp_extract(base_url, "^([^:/?#]+://[^/?#]*)", 1)
    return F.array(*[
        F.struct(F.lit(rank).alias("guess"), F.concat(root, F.lit(path)).alias("sitemap_url"))
        for rank, path in enumerate(SITEMAP_GUESSES)
    ])


def with_sitemap_guesses(seeds: DataFrame, base_url: str = "url") -> DataFrame:
    return seeds.select("*", F.inline(sitemap_guesses(F.col(base_url))))


def claim_events(events: DataFrame) -> DataFrame:
    """Request events (event_id, ts, url, op) from an event table or stream."""
    return events.select("event_id", "ts", "url", "op")
