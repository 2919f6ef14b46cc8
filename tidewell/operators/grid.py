"""Irregular readings onto a regular weekly grid, filled by iterative singular-spectrum imputation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import day_number, week_number
from tidewell.operators.skew import spread, whole_groups

WINDOW = 26
RANK = 3
#: Rounds after which a series that still moves is given up; its filled weeks are marked as not converged.
ROUNDS = 5_000
TOLERANCE = 1e-6
BATCH_ROWS = 50_000


def impute(values: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, bool]:
    """values with its nans filled, and whether the rounds converged; the first and last must not be nan.

    The gaps start as straight lines. Each round embeds the series in its trajectory (Hankel) matrix, keeps the leading
    singular vectors, averages the antidiagonals back to a series and takes its values where there was a gap, until they
    move by less than tolerance of the series' spread: it takes dozens of rounds as a rule, thousands where a gap is long. A series of fewer than four points keeps the straight lines.
    """
    x = np.asarray(values, float)
    gap = np.isnan(x)
    if not gap.any():
        return x, True
    at = np.arange(len(x))
    x = np.where(gap, np.interp(at, at[~gap], x[~gap]), x)
    n = len(x)
    length = min(window, n // 2)
    if length < 2:
        return x, True
    middle, spread = x[~gap].mean(), x[~gap].std()
    if spread == 0 or not np.isfinite(spread):
        return x, True
    y = (x - middle) / spread
    rows = n - length + 1
    counts = np.convolve(np.ones(rows), np.ones(length))
    for _ in range(rounds):
        hankel = np.lib.stride_tricks.sliding_window_view(y, length)
        _, vectors = np.linalg.eigh(hankel.T @ hankel)
        lead = vectors[:, -min(rank, length):]
        scores = hankel @ lead
        smooth = sum(np.convolve(scores[:, k], lead[:, k]) for k in range(lead.shape[1])) / counts
        moved = np.abs(smooth[gap] - y[gap]).max()
        y = np.where(gap, smooth, y)
        if moved < tolerance:
            return np.where(gap, y * spread + middle, x), True
    return np.where(gap, y * spread + middle, x), False


def weekly_runs(readings: DataFrame, *, by: list[str], at: str, value: str, longest_gap: str) -> DataFrame:
    """One row per (by, week with a reading): week, run, value (the mean), readings.

    readings must hold usable readings only; rows with a null by, at or value are left out. Two neighbouring readings
    more than longest_gap apart (an interval, exact time) end one run and start the next. A gap that long always
    crosses a week's end, so each week is first reduced to its first and last time, count and sum, before the shuffle.
    """
    held = readings.dropna(subset=[*by, at, value])
    weeks = held.groupBy(*by, week_number(day_number(at)).alias("week")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count("*").alias("readings"), F.avg(value).alias("value")
    )
    w = Window.partitionBy(*by).orderBy("week")
    broken = F.col("_first") > F.lag("_last").over(w) + F.expr(f"interval {longest_gap}")
    return (
        weeks.withColumn("_new", F.when(broken, 1).otherwise(0))
        .withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*by, "run", "week", "value", "readings")
    )


def weekly_grid(readings: DataFrame, *, by: list[str], at: str, value: str, longest_gap: str = "56 days", window: int = WINDOW, rank: int = RANK) -> DataFrame:
    """A regular weekly series per by and run: by, run, week (number), value, readings (0 in a filled week), filled, converged.

    See weekly_runs for runs and for rows that take no part. Weeks between a run's first and last reading that hold no
    reading are filled by impute and marked; converged is false throughout a run whose imputation didn't settle. A run of one week is that week. Empty input gives no rows. A series is as
    long as its calendar has weeks, whatever the number of readings.
    """
    runs = weekly_runs(readings, by=by, at=at, value=value, longest_gap=longest_gap)
    schema = runs.select(*by, "run", "week", "value", "readings", F.lit(False).alias("filled"), F.lit(True).alias("converged")).schema
    keys = [*by, "run"]

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys, BATCH_ROWS):
            week = f["week"].to_numpy(np.int64)
            group = f.groupby(keys, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(f)]
            sizes = week[ends - 1] - week[starts] + 1
            first = np.r_[0, np.cumsum(sizes)]
            owner = np.repeat(starts, sizes)
            out = f[keys].iloc[owner].reset_index(drop=True)
            out["week"] = np.arange(len(owner)) - np.repeat(first[:-1], sizes) + week[owner]
            run = np.repeat(np.arange(len(starts)), ends - starts)
            place = first[:-1][run] + week - week[starts][run]
            series, readings_ = np.full(len(owner), np.nan), np.zeros(len(owner), np.int64)
            series[place] = f["value"].to_numpy(float)
            readings_[place] = f["readings"].to_numpy(np.int64)
            settled = np.ones(len(owner), bool)
            for a, b in zip(first[:-1], first[1:]):
                series[a:b], settled[a:b] = impute(series[a:b], window, rank)
            out["value"], out["readings"], out["filled"], out["converged"] = series, readings_, readings_ == 0, settled
            yield out

    return spread(runs, *by, "run").sortWithinPartitions(*by, "run", "week").mapInPandas(fill, schema)


def usable(field: Column, at_least: float | None = None, below_size: float | None = None, but: float | None = None) -> Column:
    """field as a double, null where it is null, nan, infinite or a stand-in: not above at_least, of size below_size or more, or equal to but."""
    d = field.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    if at_least is not None:
        bad = bad | (d <= at_least)
    if below_size is not None:
        bad = bad | (F.abs(d) >= below_size)
    if but is not None:
        bad = bad | (d == but)
    return F.when(~bad, d)
