"""Joins and rankings that hold when one key owns a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle, width

SLOT_ROWS = 1_000_000
"""Rows of one key that a single task takes."""
HOT_KEYS = 1_000_000
"""Upper bound on the number of keys that are split, hence on what is broadcast; reached at SLOT_ROWS * HOT_KEYS rows."""
FEW_ROWS = 20_000
"""Rows up to which a frame known to be small, such as one row per month, is broadcast."""
SLOT = "_slot"


def hot_keys(df: DataFrame, on: list[str], slot_rows: int = SLOT_ROWS, rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``slot_rows`` rows and the number of slots each is split into.

    A slot has at most ``slot_rows`` rows at every size. Beyond ``slot_rows * HOT_KEYS`` rows only keys
    with more than ``rows / HOT_KEYS`` are split, so the list stays bounded. None when no key can be hot.
    """
    rows = df.count() if rows is None else rows
    if rows <= slot_rows:
        return None
    cut = max(slot_rows, rows // HOT_KEYS)
    return settle(
        df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cut)
        .select(*on, F.ceil(F.col("_n") / slot_rows).cast("int").alias("_slots")))


def split(df: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """Give each row of the many-rows side a slot of its key."""
    if hot is None:
        return df
    rest = [c for c in df.columns if c not in on] or on
    slots = F.coalesce("_slots", F.lit(1))
    return (df.join(F.broadcast(hot), on, "left")
            .withColumn(SLOT, F.pmod(F.xxhash64(*rest), slots).cast("int")).drop("_slots"))


def replicate(df: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """Copy each row of the one-row-per-key side to every slot of its key."""
    if hot is None:
        return df
    slots = F.coalesce("_slots", F.lit(1))
    return (df.join(F.broadcast(hot), on, "left")
            .withColumn(SLOT, F.explode(F.sequence(F.lit(0), slots - 1))).drop("_slots"))


def hot_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner",
             slot_rows: int = SLOT_ROWS, rows: int | None = None) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``on``) with the hot keys of ``many`` split over tasks."""
    hot = hot_keys(many, on, slot_rows, rows)
    keys = on if hot is None else [*on, SLOT]
    return split(many, on, hot).join(replicate(one, on, hot), keys, how).drop(SLOT)


def with_small(df: DataFrame, few: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join ``df`` to a frame with few rows, such as one per month, without moving ``df``.

    ``rows`` is the size of ``few`` if known; else it is computed first and counted. Beyond
    ``FEW_ROWS`` rows it is not broadcast, and the hot keys of ``df`` are split instead.
    """
    if rows is None:
        few = settle(few)
        rows = few.count()
    if rows <= FEW_ROWS:
        return df.join(F.broadcast(few), on, how)
    return hot_join(df, few, on, how)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str,
                  group_rows: int = SLOT_ROWS) -> DataFrame:
    """Running sum within each key, the row itself included; ``order`` should leave no large ties.

    Groups of a checked size use a window. Beyond it the rows are range-partitioned by key
    and order, summed inside each range, and shifted by the totals of the ranges before.
    """
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if largest_group(df, keys) <= group_rows:
        return df.withColumn(name, F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*so_far)))
    # The range of a row must be the same in both uses below, so it is written once.
    placed = settle(df.repartitionByRange(width(df.sparkSession) * 4, *[F.col(k) for k in keys], *order)
                    .withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_n"))
             .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*so_far)
    return (placed.withColumn("_inside", F.sum(amount).over(inside)).join(shift, [*keys, "_range"])
            .withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_range"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "position",
           group_rows: int = SLOT_ROWS) -> DataFrame:
    """Row number within each key; large groups are numbered range by range."""
    return running_total(df, keys, order, F.lit(1), name, group_rows)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, group_rows: int = SLOT_ROWS) -> DataFrame:
    """First ``n`` rows of each key with their ``position``; small ``n`` is cut before the shuffle."""
    if n <= 1000:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("position", number).where(F.col("position") <= n)
    return ranked(df, keys, order, "position", group_rows).where(F.col("position") <= n)


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str,
                   group_rows: int = SLOT_ROWS) -> DataFrame:
    """Exact quantile with linear interpolation, one row per key."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count")))
    sizes = counts.groupBy(*keys).agg(F.sum("_count").alias("_n"))
    upto = running_total(counts, keys, [F.col(value)], F.col("_count"), "_upto", group_rows)
    # Positions are 0-based; a value covers those from _upto - _count to _upto - 1.
    point = F.lit(q) * (F.col("_n") - 1)
    covers = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_count") <= at)
    near = with_small(upto, sizes, keys).where(covers(F.floor(point)) | covers(F.ceil(point)))
    low, high = F.min(value), F.max(value)
    return near.groupBy(*keys, "_n").agg((low + (high - low) * (point - F.floor(point))).alias(name)).drop("_n")
