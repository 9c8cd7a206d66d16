"""Live quota: decisions and first sightings from a stream of request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import DAILY_SITES
from ..operators.quota import CLAIMING, accepted_sites, quota_decisions, with_day_and_site
from ..session import cut_lineage, make_folder, remove_folder
from ..sources.tables import EVENTS, file_stream

DECIDED = "day date, site_key string, decision string, used bigint, retry_after bigint, batch bigint"
SIGHTED_AT = "seen_day string, batch bigint"
NO_DAY = "none"
# rows in one file of sightings that were written together
COMPACT_ROWS = 1_000_000


def read_events(spark: SparkSession, folder: str, names: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    return file_stream(spark, EVENTS, folder, names, files_per_batch)


class QuotaBatches:
    """`foreachBatch` step: decides one micro-batch against the sites accepted before it.

    A state store keyed by day would send all events of a day to one task. Instead each batch
    runs the batch job, and what is carried over is a table of accepted sites: at most `limit`
    rows per day. The table is versioned by batch id, written after the decisions, and every
    write replaces its own folder, so a batch that is run again gives the same result.
    """

    def __init__(self, path: str, limit: int = DAILY_SITES, keep_days: int | None = None):
        """`keep_days`: days before the present UTC date whose sites are kept; None keeps all.

        A day has at most `limit` rows, so keeping all is cheap and late events are decided like
        any other. Event times never remove a day. Events of days no longer kept are not decided
        but written to the folder `late`.
        """
        self.path = path
        self.limit = max(1, limit)
        self.keep_days = keep_days

    def _state(self, batch_id: int) -> str:
        return f"{self.path}/state/v{batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # read for the claims, the decisions and the late events
        carried = None
        if batch_id > 0:
            carried = spark.read.schema("day date, site_key string").parquet(self._state(batch_id - 1))
        if self.keep_days is not None:
            oldest = F.date_sub(F.current_date(), self.keep_days)
            batch.filter(F.to_date("ts") < oldest).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
            decided = batch.filter(F.to_date("ts") >= oldest)
            carried = None if carried is None else carried.filter(F.col("day") >= oldest)
        else:
            decided = batch
        accepted = cut_lineage(accepted_sites(decided, self.limit, carried))
        quota_decisions(decided, self.limit, accepted=accepted).write.mode("overwrite").parquet(
            f"{self.path}/decisions/batch={batch_id}")
        accepted.select("day", "site_key").repartition(1).write.mode("overwrite").parquet(self._state(batch_id))
        # the version before stays: this batch may be run again
        remove_folder(spark, self._state(batch_id - 2))
        batch.unpersist()


def start_quota_stream(events: DataFrame, path: str, limit: int = DAILY_SITES, **trigger):
    """Decisions in arrival order of the batches; inside a batch by (ts, event_id)."""
    return (
        events.writeStream.foreachBatch(QuotaBatches(path, limit))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_quota_stream(events: DataFrame, path: str, limit: int = DAILY_SITES) -> DataFrame:
    """Process what has arrived and return the decisions of this and all earlier runs."""
    spark = events.sparkSession
    make_folder(spark, f"{path}/decisions")
    start_quota_stream(events, path, limit).awaitTermination()
    schema = T.StructType(events.schema.fields + T.StructType.fromDDL(DECIDED).fields)
    return spark.read.schema(schema).parquet(f"{path}/decisions").drop("batch")


class FirstClaimBatches:
    """`foreachBatch` step: writes each (day, site_key) once, in the batch that first has it.

    What is carried over are the sightings of the batches before, so event time removes nothing: a late
    event, or any event after one dated in the future, is a first sighting like any other. Sightings
    lie in folders by day and a batch reads its own days only, so its cost follows the days it holds,
    not the history. A batch looks at batches before it only and replaces its own rows, so one that
    is run again gives the same rows. Every `compact_every` batches the small files of the days at
    hand are written together.
    """

    def __init__(self, path: str, compact_every: int = 50):
        self.path = path
        self.compact_every = compact_every

    def before(self, spark: SparkSession, days: list, batch_id: int) -> DataFrame:
        """Sightings of these days that earlier batches wrote; other days' folders are not read."""
        rows = spark.read.schema(f"site_key string, {SIGHTED_AT}").parquet(f"{self.path}/sightings")
        return rows.filter(F.col("seen_day").isin(days) & (F.col("batch") < batch_id)).select("site_key", "seen_day", "batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        make_folder(spark, f"{self.path}/sightings")
        seen = cut_lineage(
            with_day_and_site(batch.filter(F.col("op").isin(*CLAIMING))).select("day", "site_key").distinct()
            .withColumn("seen_day", F.coalesce(F.col("day").cast("string"), F.lit(NO_DAY))))
        # one number per day of a batch
        days = [r.seen_day for r in seen.select("seen_day").distinct().collect()]
        known = self.before(spark, days, batch_id).select(F.col("seen_day").alias("d"), F.col("site_key").alias("s"))
        same = (F.col("seen_day") == F.col("d")) & F.col("site_key").eqNullSafe(F.col("s"))
        new = seen.join(known, same, "left_anti").select("site_key", F.lit(batch_id).cast("bigint").alias("batch"), "seen_day")
        for day in days:
            remove_folder(spark, f"{self.path}/sightings/seen_day={day}/batch={batch_id}")
        new.repartition("seen_day").write.mode("append").partitionBy("seen_day", "batch").parquet(f"{self.path}/sightings")
        if self.compact_every and batch_id % self.compact_every == self.compact_every - 1:
            for day in days:
                self.compact(spark, day, batch_id)

    def compact(self, spark: SparkSession, day: str, batch_id: int) -> None:
        """Write a day's earlier batches together as one, and remove their folders afterwards.

        The rows are in two places for a moment, which a distinct read does not mind. The batch that may
        be run again keeps its own folder.
        """
        old = self.before(spark, [day], batch_id)
        batches = [r.batch for r in old.select("batch").distinct().collect()]
        if len(batches) < 2:
            return
        last = max(batches)
        whole = cut_lineage(old.select("site_key").distinct())
        part = f"{self.path}/sightings/seen_day={day}/batch="
        whole.repartition(1 + whole.count() // COMPACT_ROWS).write.mode("overwrite").parquet(f"{part}{last}")
        for b in batches:
            if b != last:
                remove_folder(spark, f"{part}{b}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """day, site_key of all batches."""
        rows = spark.read.schema(f"site_key string, {SIGHTED_AT}").parquet(f"{self.path}/sightings")
        day = F.when(F.col("seen_day") != NO_DAY, F.col("seen_day").cast("date"))
        return rows.select(day.alias("day"), "site_key").distinct()


def run_first_claims_stream(events: DataFrame, path: str) -> DataFrame:
    """day, site_key once per day, as soon as it is first seen; all that have arrived."""
    spark = events.sparkSession
    step = FirstClaimBatches(f"{path}/rows")
    make_folder(spark, f"{path}/rows/sightings")
    (
        events.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return step.rows(spark)
