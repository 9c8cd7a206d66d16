"""Counts and positions over verdict and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import first_per_group, running_sums


def succeeded() -> Column:
    return F.col("error").isNull()


def selectable_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("seed_id").agg(
        F.count_if("selectable").alias("selectable"), F.count("*").alias("total"))


def export_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seed_id").agg(
        F.count_if(succeeded()).alias("ok"), F.count_if(~succeeded()).alias("failed"),
        F.count("*").alias("total"))


def export_progress(rows: DataFrame) -> DataFrame:
    """rows (seed_id, pos, error) → index, ok, failed and percent after each row."""
    ok = succeeded().cast("bigint")
    # read for the block bounds, the block totals and the rows
    rows = cut_lineage(rows.select("seed_id", "pos", "error"))
    summed = running_sums(
        rows, ["seed_id"], "pos", {"ok": ok, "failed": F.lit(1) - ok}, totals=True)
    index = F.col("ok") + F.col("failed")
    total = F.col("ok_total") + F.col("failed_total")
    # half a percent rounds up, in whole numbers
    percent = F.floor((index * 200 + total) / (total * 2)).cast("bigint")
    return summed.select("seed_id", "pos", index.alias("index"), "ok", "failed", percent.alias("percent"))


def cap_per_seed(urls: DataFrame, limit: Column | int | None = None) -> DataFrame:
    """The first `limit` rows of each seed by position; None keeps all."""
    return urls if limit is None else first_per_group(urls, ["seed_id"], "pos", limit).drop("rank")


def over_limit(urls: DataFrame, limit: int | None) -> DataFrame:
    """Adds `over_limit`: whether a row comes after the first `limit` rows of its seed."""
    if limit is None:
        return urls.withColumn("over_limit", F.lit(False))
    counted = running_sums(urls, ["seed_id"], "pos", {"_nth": F.lit(1)})
    return counted.select(*urls.columns, (F.col("_nth") > limit).alias("over_limit"))


def ordered_output(rows: DataFrame) -> DataFrame:
    """Rows in request order; only a sink that keeps the order needs it."""
    return rows.orderBy("seed_id", "pos")
