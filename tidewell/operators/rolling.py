"""Totals over trailing periods of days, by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every_day(daily: DataFrame, *, by: list[str], day: str, values: list[str], longest_gap: int | None = None) -> DataFrame:
    """One row for each entity and calendar day of each run: by, run, day, values (null on days without a row).

    daily has one row per (by, day), day being a day number. A run goes from its first to its last day; where two
    neighbouring days are more than longest_gap apart, it ends and another starts. Rows with a null day are left out.
    An entity has as many rows as its calendar has days, so its size is bounded by time, not by the number of records.
    """
    w = Window.partitionBy(*by).orderBy(day)
    ahead = F.lead(day).over(w)
    gap = F.lit(False) if longest_gap is None else ahead - F.col(day) > longest_gap
    fill = F.when(ahead.isNull() | gap, F.array(F.col(day))).otherwise(F.sequence(F.col(day), ahead - 1))
    starts = F.lag(F.when(gap, 1).otherwise(0), 1, 0).over(w)
    spread = (
        daily.where(F.col(day).isNotNull())
        .select(*by, day, *values, fill.alias("_days"), starts.alias("_start"))
        .withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*by, "run", F.col(day).alias("_own"), *values, F.explode("_days").alias("_day"))
    )
    kept = [F.when(F.col("_own") == F.col("_day"), F.col(v)).alias(v) for v in values]
    return spread.select(*by, "run", F.col("_day").alias(day), *kept)


def trailing(dense: DataFrame, *, by: list[str], day: str, values: list[str], days: list[int]) -> DataFrame:
    """Adds <value>_<n> for each value and each n of days: the total of the n days that end with the row's day.

    dense has every day of every (by, run) once, as every_day gives it; days before the run hold nothing, nulls count
    as 0. Blocks of 1, 2, 4, 8, ... days are built by adding each block to the one before it, and a period of n days is
    put together from the blocks of n's binary digits. Nothing is ever subtracted, so a total of zeros is exactly 0.
    All steps share one partitioning and order: one shuffle and one sort.
    """
    if not days or min(days) < 1:
        raise ValueError("days must be positive")
    w = Window.partitionBy(*by, "run").orderBy(day)
    back = lambda c, k: c if k == 0 else F.coalesce(F.lag(c, k).over(w), F.lit(0))
    out = dense.select("*", *[F.coalesce(F.col(v), F.lit(0)).alias(f"_{v}_0") for v in values])
    digits = max(days).bit_length()
    for k in range(1, digits):
        half = 1 << (k - 1)
        out = out.select("*", *[(F.col(f"_{v}_{k - 1}") + back(F.col(f"_{v}_{k - 1}"), half)).alias(f"_{v}_{k}") for v in values])
    totals = []
    for n in days:
        for v in values:
            total: Column | None = None
            passed = 0
            for k in range(digits - 1, -1, -1):
                if n >> k & 1:
                    block = back(F.col(f"_{v}_{k}"), passed)
                    total = block if total is None else total + block
                    passed += 1 << k
            totals.append(total.alias(f"{v}_{n}"))
    return out.select(*dense.columns, *totals)
