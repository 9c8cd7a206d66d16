"""Daily site quota over request events.

The first discover or scrape event of a site claims it for its UTC day; a day accepts the
first `limit` sites. The claims are aggregated per (day, site) map-side and cut to `limit` per
day before the shuffle, so neither a busy day nor a busy site gathers its events in one task.
Events then meet two small tables by equality: the accepted sites by (day, site), and running
counts of them by (day, minute). What an event costs does not depend on the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import DAILY_SITES, STORE_RETRY_SECONDS
from ..functions.urls import host_of, site_key
from ..session import BROADCAST_BYTES, cut_lineage, measured

MINUTES = 24 * 60
# bytes of an accepted site besides its name, and of a minute's row
ROW_BYTES = 64
# up to this limit Spark cuts the rows of a window in each task before it shuffles them
TOP_ROWS = "spark.sql.optimizer.windowGroupLimitThreshold"
CLAIMING = ("discover", "scrape")


def with_day_and_site(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "day": F.to_date("ts"), "site_key": site_key(host_of(F.col("url")), F.col("url"))})


def first_claims(events: DataFrame) -> DataFrame:
    """day, site_key, first STRUCT<ts, event_id>: the event that claims the site."""
    return (
        with_day_and_site(events)
        .filter(F.col("op").isin(*CLAIMING))
        .groupBy("day", "site_key")
        .agg(F.min(F.struct("ts", "event_id")).alias("first"))
    )


def earliest_claims(claims: DataFrame) -> DataFrame:
    """The first `_room` claims of each day (day, site_key, first, _room), by selection.

    Counts per second of a day tell in which second the room ends. Claims of later seconds are left
    out, and ranks run inside a second, so no task has the claims of a day. Counts are at most 86,400
    rows a day.
    """
    ts = F.col("first.ts")
    second = F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts), F.lit(-1))
    timed = claims.withColumn("_second", second)
    before = Window.partitionBy("day").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    left = (
        timed.groupBy("day", "_second").agg(F.count("*").alias("_n"), F.max("_room").alias("_room"))
        .select(F.col("day").alias("_day"), F.col("_second").alias("_at"),
                (F.col("_room") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_left"))
        .filter("_left > 0"))
    same = F.col("day").eqNullSafe(F.col("_day")) & (F.col("_second") == F.col("_at"))
    rank = F.row_number().over(Window.partitionBy("day", "_second").orderBy("first"))
    return timed.join(left, same).withColumn("_rank", rank).filter("_rank <= _left").select("day", "site_key", "first")


def accepted_sites(events: DataFrame, limit: int = DAILY_SITES,
                   carried: DataFrame | None = None) -> DataFrame:
    """day, site_key, first: the sites a day accepts, in claim order.

    `carried` (day, site_key) holds sites accepted earlier, outside `events`; they keep their
    slots and appear with a NULL `first`.
    """
    limit = max(1, limit)
    claims = first_claims(events)
    room = F.lit(limit)
    if carried is not None:
        taken = carried.groupBy("day").agg(F.count("*").alias("_taken"))
        claims = claims.join(carried, ["day", "site_key"], "left_anti").join(taken, "day", "left")
        room = F.lit(limit) - F.coalesce("_taken", F.lit(0))
    if limit <= int(claims.sparkSession.conf.get(TOP_ROWS)):
        # the literal bound comes first: it is the one applied before the shuffle
        ranked = claims.withColumn(
            "_rank", F.row_number().over(Window.partitionBy("day").orderBy("first"))
        ).filter(F.col("_rank") <= limit)
        fresh = ranked.filter(F.col("_rank") <= room).select("day", "site_key", "first")
    else:
        fresh = earliest_claims(claims.withColumn("_room", room))
    if carried is None:
        return fresh
    return fresh.unionByName(
        carried.select("day", "site_key", F.lit(None).cast(fresh.schema["first"].dataType).alias("first")))


def retry_after(ts: Column) -> Column:
    """Whole seconds to the next UTC midnight, at least 1, and 1 at midnight itself."""
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60) + F.date_part(F.lit("SECOND"), ts)
    return F.when(second == 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.lit(86400) - F.ceil(second))).cast("bigint")


def minute_of(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def used_by_minute(accepted: DataFrame) -> DataFrame:
    """day, minute, _before, _within: sites accepted before that minute, and their claims in it.

    One row per minute of each day with an accepted site. Sites carried over come before all.
    """
    claims = accepted.groupBy("day", F.coalesce(minute_of(F.col("first.ts")), F.lit(-1)).alias("minute")).agg(
        F.array_sort(F.collect_list("first")).alias("_within"), F.count("*").alias("_n"))
    minutes = accepted.select("day").distinct().select("day", F.explode(F.sequence(F.lit(-1), F.lit(MINUTES - 1))).alias("minute"))
    before = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    return minutes.join(claims, ["day", "minute"], "left").select(
        "day", "minute", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_within")


def quota_decisions(events: DataFrame, limit: int = DAILY_SITES,
                    carried: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """events (event_id, ts, url, op) → day, site_key, decision, used, retry_after.

    claimed / already / continued / limit for claiming operations, already / limit / ok for
    `check`. `used` counts the accepted sites up to the event; `retry_after` is 0 unless refused.
    The two small tables are broadcast if they measure small enough; else events are shuffled by
    (day, site) and by (day, minute), never by day. `accepted` may be given, as accepted_sites()
    makes it.
    """
    limit = max(1, limit)
    if accepted is None:
        accepted = cut_lineage(accepted_sites(events, limit, carried))
    n_sites, name_bytes = measured(accepted, "site_key")
    n_days = accepted.select("day").distinct().count()
    minutes = used_by_minute(accepted)
    own = accepted.select("day", "site_key", F.col("first").alias("_own"), F.lit(True).alias("_known"))
    if name_bytes + ROW_BYTES * n_sites <= BROADCAST_BYTES:
        own = F.broadcast(own)
    if ROW_BYTES * (n_sites + n_days * MINUTES) <= BROADCAST_BYTES:
        minutes = F.broadcast(minutes)
    c = F.col
    now = F.struct("ts", "event_id")
    staged = (
        with_day_and_site(events).withColumns({"_now": now, "minute": minute_of(c("ts"))})
        .join(own, ["day", "site_key"], "left").join(minutes, ["day", "minute"], "left")
        .withColumn("used", (F.coalesce("_before", F.lit(0)) + F.when(
            c("_within").isNull(), 0).otherwise(F.size(F.filter("_within", lambda a: a <= c("_now"))))).cast("bigint"))
    )
    here = F.coalesce("_known", F.lit(False)) & (c("_own").isNull() | (c("_own") <= c("_now")))
    decision = (
        F.when((c("op") == "check") & here, "already")
        .when(c("op") == "check", F.when(c("used") >= limit, "limit").otherwise("ok"))
        .when(~here, "limit")
        .when(c("_own") == c("_now"), "claimed")
        .when(c("op") == "discover", "already")
        .otherwise("continued")
    )
    return staged.withColumn("decision", decision).select(
        *events.columns, "day", "site_key", "decision", "used",
        F.when(c("decision").isin("already", "limit"), retry_after(c("ts")))
        .otherwise(F.lit(0)).cast("bigint").alias("retry_after"))


def store_failure_decisions(events: DataFrame) -> DataFrame:
    """Decisions while the claim table cannot be read: everything is refused for a minute."""
    return with_day_and_site(events).select(
        *events.columns, "day", "site_key", F.lit("unavailable").alias("decision"),
        F.lit(None).cast("bigint").alias("used"), F.lit(STORE_RETRY_SECONDS).cast("bigint").alias("retry_after"))


def daily_site_usage(events: DataFrame, limit: int = DAILY_SITES) -> DataFrame:
    """day, used, site_limit, remaining. Counting needs no ranking: a day accepts its distinct
    claiming sites up to the limit."""
    limit = max(1, limit)
    used = F.least(F.count("*"), F.lit(limit)).cast("bigint")
    days = first_claims(events).groupBy("day").agg(used.alias("used"))
    return days.select(
        "day", "used", F.lit(limit).cast("bigint").alias("site_limit"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("used")).cast("bigint").alias("remaining"))


def unseen_sites(events: DataFrame, limit: int = DAILY_SITES) -> DataFrame:
    """day, site_key pairs asked for but not accepted that day."""
    asked = with_day_and_site(events).select("day", "site_key").distinct()
    return asked.join(accepted_sites(events, limit), ["day", "site_key"], "left_anti")
