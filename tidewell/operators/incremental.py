"""High-water marks: compute only what is new, from as much history as the features look back on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Calendar days per row of lookback, and days on top.
DAYS_PER_ROW, SPARE_DAYS = 1.5, 5


def lookback_days(rows: int) -> int:
    """Calendar days that hold at least so many rows of a weekday series."""
    return int(rows * DAYS_PER_ROW) + SPARE_DAYS


def fresh_features(bars: DataFrame, marks: DataFrame, features: Callable[[DataFrame], DataFrame], *, by: str, at: str, lookback_rows: int) -> DataFrame:
    """features(bars) for the rows after each key's mark only.

    marks has one row per by with the column watermark; a key without one is computed in full. Of the rows up to the mark
    only the last lookback_rows of each key go into the windows, however far apart they are: the planner cuts each task's
    rows to that many per key before the shuffle. Equal to the full computation wherever features look back no further.
    """
    joined = bars.join(marks.select(by, "watermark"), by, "left")
    fresh = F.col("watermark").isNull() | (F.col(at) > F.col("watermark"))
    old = joined.where(F.col("watermark").isNotNull() & (F.col(at) <= F.col("watermark")))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc()))
    past = old.withColumn("_nth", nth).where(F.col("_nth") <= lookback_rows).drop("_nth", "watermark")
    loaded = joined.where(fresh).drop("watermark").unionByName(past)
    return features(loaded).join(marks.select(by, "watermark"), by, "left").where(fresh).drop("watermark")


def advance(marks: DataFrame, computed: DataFrame, *, by: str, at: str, cap: DataFrame | None = None) -> DataFrame:
    """New marks: the last computed time of each key, no later than cap's last_input where one is given, never moved back."""
    last = computed.groupBy(by).agg(F.max(at).alias("_last"))
    out = marks.select(by, "watermark").join(last, by, "full_outer")
    if cap is not None:
        out = out.join(cap.select(by, "last_input"), by, "left").withColumn("_last", F.least("_last", F.coalesce("last_input", "_last")))
    return out.select(by, F.greatest("watermark", "_last").alias("watermark"))


def changed(old_hashes: DataFrame, new_hashes: DataFrame, *, by: str) -> DataFrame:
    """Keys whose hash was known and is another now: their marks must go back to the start."""
    return old_hashes.select(by, F.col("hash").alias("_old")).join(new_hashes.select(by, "hash"), by).where("_old <> hash").select(by)


def reset(marks: DataFrame, keys: DataFrame, *, by: str) -> DataFrame:
    """marks without the keys that must be computed anew."""
    return marks.join(keys.select(by).distinct(), by, "left_anti")
