"""Export as requests arrive, and running counts per seed: the batch verdict on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.export import export_rows, fetch_verdict, spread_key, with_text_and_title
from ..operators.links import page_address
from ..operators.progress import export_summary
from ..session import make_folder, newest_version, remove_folder
from ..sources.tables import file_stream

# requests with language variants already collapsed, as a site's list is made before it is fetched
REQUESTS = T.StructType([
    T.StructField("seed_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("url", T.StringType())])
ROWS = "seed_id bigint, pos bigint, url string, title string, text string, error string, requested_url string"
# several bodies of one address may meet a request: each gives a row, and joined_rows() chooses
JOINED = f"{ROWS}, page_url string"
TIMED_REQUESTS = T.StructType([*REQUESTS.fields, T.StructField("asked_at", T.TimestampType())])
ARRIVING_PAGES = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("arrived_at", T.TimestampType())])
# an address asked for by a third of all requests is dealt out over so many tasks
SPREAD = 4
SUMMARY = "seed_id bigint, ok bigint, failed bigint, total bigint"


def read_requests(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return file_stream(spark, REQUESTS, folder, names, files_per_batch)


def run_export_stream(requests: DataFrame, seeds: DataFrame, policy: DataFrame, responses: DataFrame,
                      bodies: DataFrame, path: str) -> DataFrame:
    """Rows of export_rows() for all requests that have arrived.

    Seeds, policy, responses and bodies are tables. Each micro-batch writes a folder of its own,
    so one that is run again replaces its rows. A run that finds nothing new, or nothing at all,
    returns the rows of the runs before it.
    """
    spark = requests.sparkSession
    make_folder(spark, f"{path}/rows")

    def export(batch: DataFrame, batch_id: int) -> None:
        rows = export_rows(fetch_verdict(batch, seeds, policy, responses), bodies)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    (
        requests.writeStream.foreachBatch(export).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(f"{ROWS}, batch bigint").parquet(f"{path}/rows").drop("batch")


def read_timed_requests(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return file_stream(spark, TIMED_REQUESTS, folder, files_per_batch=files_per_batch)


def read_arriving_pages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return file_stream(spark, ARRIVING_PAGES, folder, files_per_batch=files_per_batch)


def with_arrival(rows: DataFrame, column: str) -> DataFrame:
    """Rows of a stream with the time of their micro-batch: with it as event time no row is ever late."""
    return rows.withColumn(column, F.current_timestamp())


def joined_export(requests: DataFrame, seeds: DataFrame, policy: DataFrame, responses: DataFrame, pages: DataFrame,
                  before: str = "1 hour", wait: str = "1 hour", late: str = "10 minutes", spread: int = SPREAD) -> DataFrame:
    """Stream of requests (seed_id, pos, url, asked_at) joined with the stream of pages (url, html, arrived_at).

    A request meets the bodies of its address that arrive up to `before` before and `wait` after it,
    gives a row per body, and without one a row `no_response` once the watermark has passed that time.
    Refused requests give their row at once. Both sides' state is dropped by the watermark, which stands
    `late` behind the slower stream: rows that come later than that are not joined, so `late` must
    cover the disorder of the sources, or with_arrival() give the times. Bodies are read for text once,
    as they arrive; state holds titles and texts. `spread` parts of an address lie in different tasks.
    """
    c = F.col
    verdicts = fetch_verdict(requests.withWatermark("asked_at", late), seeds, policy, responses).withColumns({
        "_key": spread_key(F.when(c("error").isNull(), page_address(c("final_url")))),
        "_part": F.pmod(F.xxhash64("seed_id", "pos"), F.lit(spread))})
    texts = with_text_and_title(pages.withWatermark("arrived_at", late)).select(
        c("url").alias("page_url"), "title", "text", "arrived_at", page_address(c("url")).alias("_page"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("_page_part"))
    met = (
        (c("_key") == c("_page")) & (c("_part") == c("_page_part")) & c("error").isNull()
        & (c("arrived_at") >= c("asked_at") - F.expr(f"INTERVAL {before}"))
        & (c("arrived_at") <= c("asked_at") + F.expr(f"INTERVAL {wait}")))
    error = F.coalesce("error", F.when(c("page_url").isNull(), "no_response"))
    return verdicts.join(texts, met, "left").select(
        "seed_id", "pos", c("final_url").alias("url"), "title", "text", error.alias("error"),
        verdicts["url"].alias("requested_url"), "page_url")


def start_joined_export(rows: DataFrame, path: str, **trigger):
    """Write the rows of joined_export() below `path`, each once whatever is run again."""
    make_folder(rows.sparkSession, f"{path}/rows")
    return (
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start(f"{path}/rows")
    )


def joined_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of export_rows() that were written so far: of a request's bodies the one with the smallest url."""
    kept = [f.split()[0] for f in ROWS.split(", ")]
    own = ("seed_id", "pos", "requested_url")
    rows = spark.read.schema(JOINED).parquet(f"{path}/rows")
    # a row without a body has no page_url, and min_by ignores rows without an order
    first = F.min_by(F.struct(*[c for c in kept if c not in own]), F.coalesce("page_url", F.lit("")))
    return rows.groupBy(*own).agg(first.alias("r")).select(*own, "r.*").select(*kept)


def run_joined_export(requests: DataFrame, seeds: DataFrame, policy: DataFrame, responses: DataFrame,
                      pages: DataFrame, path: str, **times) -> DataFrame:
    """joined_export() over all that has arrived; requests whose time has not passed are still open."""
    rows = joined_export(requests, seeds, policy, responses, pages, **times)
    start_joined_export(rows, path).awaitTermination()
    return joined_rows(requests.sparkSession, path)


def run_progress_stream(requests: DataFrame, seeds: DataFrame, policy: DataFrame, responses: DataFrame,
                        path: str) -> DataFrame:
    """seed_id, ok, failed, total after all requests that have arrived.

    The verdict is a join of the stream with tables; the counts are a streaming aggregation whose
    changed rows replace the seeds' rows in a table with one version per batch. The last two
    versions are kept: one to read, one to run a batch again from. The newest complete version on
    disk is returned, so a run that finds nothing new gives the counts of the runs before it.
    """
    spark = requests.sparkSession
    version = f"{path}/counts/v{{}}".format

    def merge(changed: DataFrame, batch_id: int) -> None:
        if batch_id:
            before = spark.read.schema(SUMMARY).parquet(version(batch_id - 1))
            changed = changed.unionByName(before.join(changed.select("seed_id"), "seed_id", "left_anti"))
        changed.write.mode("overwrite").parquet(version(batch_id))
        remove_folder(spark, version(batch_id - 2))

    counts = export_summary(fetch_verdict(requests, seeds, policy, responses))
    (
        counts.writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    last = newest_version(spark, f"{path}/counts")
    if last is None:
        return spark.createDataFrame([], SUMMARY)
    return spark.read.schema(SUMMARY).parquet(version(last))
