"""Ranks and running sums along a position, safe for groups of any size.

A plain window over a seed sends all rows of that seed to one task. Here positions are cut
into blocks first: block totals are summed map-side, a window runs over the block totals
only, and the row-level window runs inside one block. The result is the same.

Blocks end at quantiles of the positions that occur, so they hold about as many rows each whether
positions are dense, sparse or clustered, and a seed has at most MAX_BLOCKS of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 8192
MAX_BLOCKS = 1024


def block_of(df: DataFrame, pos: str, block_rows: int) -> Column:
    """Number of the block a position lies in. One aggregation of bounded size finds the bounds."""
    steps = [k / MAX_BLOCKS for k in range(1, MAX_BLOCKS)]
    found = df.agg(F.count(pos).alias("n"), F.percentile_approx(pos, steps, 20 * MAX_BLOCKS).alias("q")).first()
    wanted = min(MAX_BLOCKS, -(-found.n // block_rows))
    if wanted < 2:
        return F.lit(0)
    bounds = sorted({found.q[k * MAX_BLOCKS // wanted - 1] for k in range(1, wanted)})
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    halves = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    # binary search: how many bounds lie below the position
    return F.aggregate(
        F.array(*map(F.lit, halves)), F.lit(0),
        lambda at, half: F.when(F.coalesce(F.get(table, at + half - 1) < F.col(pos), F.lit(False)), at + half).otherwise(at))


def running_sums(df: DataFrame, group: list[str], pos: str, sums: dict[str, Column],
                 totals: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add, per name in `sums`, the inclusive running sum along `pos` (unique per group).

    With `totals`, also `<name>_total` over the whole group.
    """
    blocked = df.withColumns({
        "_block": block_of(df, pos, block_rows),
        **{f"_v_{n}": e.cast("bigint") for n, e in sums.items()},
    })
    keys = [*group, "_block"]
    per_block = blocked.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_block.select(
        *keys,
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *([F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []),
    )
    inside = Window.partitionBy(*keys).orderBy(pos).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        blocked.join(offsets, keys)
        .withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside) for n in sums})
        .select(*df.columns, *sums, *([f"{n}_total" for n in sums] if totals else []))
    )


def first_per_group(df: DataFrame, group: list[str], pos: str, limit: Column | int,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose rank along `pos` is at most `limit` (a number or a column of the group).

    Blocks that start beyond the limit are dropped before any row is ranked, so the row-level
    window sees at most `limit` rows plus one block per group. Adds `rank`.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    blocked = df.withColumns({
        "_block": block_of(df, pos, block_rows), "_limit": limit})
    keys = [*group, "_block"]
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_limit").alias("_cap"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_before") < F.col("_cap"))
        .select(*keys, "_before")
    )
    inside = Window.partitionBy(*keys).orderBy(pos)
    return (
        blocked.join(offsets, keys)
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .filter(F.col("rank") <= F.col("_limit"))
        .select(*df.columns, "rank")
    )


def sums_before(df: DataFrame, group: list[str], order: list[str], amount: Column) -> DataFrame:
    """Add `before`: the sum of `amount` over the rows of the group that come before in `order`.

    `order` may be of any sortable types. Rows are sorted by ranges over (group, order), which split a
    group of any size evenly, and written once, so that their places hold. Totals are taken per group
    and range, a window runs over those (a row per range at most), and the row-level window inside
    one range. Rows equal in (group, order) come in any order; the group is not NULL.
    """
    keys = [*group, *order]
    placed = cut_lineage(
        df.withColumn("_amount", amount.cast("bigint")).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_range", F.expr("shiftright(_id, 33)"))  # the id begins with the number of the partition
    parts = [*group, "_range"]
    earlier = (Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*parts).agg(F.sum("_amount").alias("_sum")).select(
        *parts, F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(*earlier)), F.lit(0)).alias("_offset"))
    inside = F.sum("_amount").over(Window.partitionBy(*parts).orderBy("_id").rowsBetween(*earlier))
    return placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, parts).select(
        *df.columns, (F.col("_offset") + F.col("_inside")).alias("before"))
