"""As-of joins: for each left row the right row of its key nearest in time on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_DAYS = 364


def asof(left: DataFrame, right: DataFrame, *, by: list[str], at: str, right_at: str, carry: list[str], tie: list[str], forward: bool = False, shard_days: int = SHARD_DAYS) -> DataFrame:
    """left with matched_at and the columns carry of the latest right row not after it (forward: the earliest not before it).

    A whole row is carried, so its nulls stay null. Of right rows with the same key and time the one with the greatest tie
    columns counts (nulls lowest). Left rows without a match, and those with a null key or time, get nulls; right rows with a null
    key or time are ignored. carry mustn't clash with left's columns.

    Keys are cut into shards of time. The last right row before a shard is put in front of it, so each window holds one
    shard of one key and not a key's whole history. Without by (an empty list) all rows are one key.
    """
    width = shard_days * 86_400_000_000
    sign = -1 if forward else 1
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * sign
    shard = F.floor(F.col("_t") / width)
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    value = F.struct(F.col(right_at).alias("matched_at"), *carry)
    rights = (
        right.dropna(subset=[*by, right_at])
        .groupBy(*keys, time(right_at).alias("_t"))
        .agg(F.max_by(value, F.struct(*tie)).alias("_v"))
        .withColumn("_s", shard)
    )
    lefts = left.withColumn("_t", time(at)).withColumn("_s", shard)
    for i, k in enumerate(by):
        lefts = lefts.withColumn(f"_k{i}", F.col(k))
    ends = rights.groupBy(*names, "_s").agg(F.max_by("_v", "_t").alias("_v"))
    asked = lefts.select(*names, "_s").distinct().withColumn("_ask", F.lit(True))
    all_shards = ends.join(asked, [*names, "_s"], "full_outer")
    earlier = Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    fronts = all_shards.withColumn("_v", F.last("_v", True).over(earlier)).where("_ask and _v is not null").select(*names, (F.col("_s") * width).alias("_t"), "_v", "_s", F.lit(0).alias("_side"))
    both = rights.select(*names, "_t", "_v", "_s", F.lit(1).alias("_side")).unionByName(fronts)
    both = both.unionByName(lefts.withColumn("_side", F.lit(2)), allowMissingColumns=True)
    w = Window.partitionBy(*names, "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last("_v", True).over(w)
    usable_row = F.col("_t").isNotNull()
    for n in names:
        usable_row = usable_row & F.col(n).isNotNull()
    out = both.withColumn("_m", seen).where("_side = 2")
    return out.select(*left.columns, *[F.when(usable_row, F.col(f"_m.{c}")).alias(c) for c in ["matched_at", *carry]])


def asof_nearest(left: DataFrame, right: DataFrame, *, by: list[str], at: str, right_at: str, carry: list[str], tie: list[str], tolerance: str, shard_days: int = SHARD_DAYS) -> DataFrame:
    """left with matched_at and carry of the right row nearest in time, at most tolerance (an interval) away; the earlier one on a tie."""
    back = asof(left, right, by=by, at=at, right_at=right_at, carry=carry, tie=tie, shard_days=shard_days)
    renamed = back.select(*left.columns, F.struct("matched_at", *carry).alias("_back"))
    both = asof(renamed, right, by=by, at=at, right_at=right_at, carry=carry, tie=tie, forward=True, shard_days=shard_days)
    gap = lambda c: F.abs(F.unix_micros(F.col(c)) - F.unix_micros(F.col(at).cast("timestamp")))
    limit = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {tolerance}"))
    earlier = F.col("_back.matched_at").isNotNull() & (F.col("matched_at").isNull() | (gap("_back.matched_at") <= gap("matched_at")))
    pick = both.withColumn("_pick", F.when(earlier, F.col("_back")).otherwise(F.struct("matched_at", *carry)))
    within: Column = F.col("_pick.matched_at").isNotNull() & (gap("_pick.matched_at") <= limit)
    return pick.select(*left.columns, *[F.when(within, F.col(f"_pick.{c}")).alias(c) for c in ["matched_at", *carry]])
