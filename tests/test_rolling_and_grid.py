import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators.grid import impute, usable, weekly_grid
from tidewell.operators.rolling import every_day, trailing

DAILY = "k string, day int, v double, run long"


def test_trailing_equals_brute_force(spark):
    rng = random.Random(2)
    rows = {(k, d): float(rng.randrange(100)) if rng.random() < 0.9 else None for k in ("a", "b", None) for d in rng.sample(range(300), 90)}
    daily = spark.createDataFrame([(k, d, v, 9) for (k, d), v in rows.items()] + [("a", None, 5.0, 9)], DAILY)
    dense = every_day(daily.drop("run"), by=["k"], day="day", values=["v"], longest_gap=5)
    out = trailing(dense, by=["k"], day="day", values=["v"], days=[1, 7, 13, 30, 64]).collect()
    for k in ("a", "b", None):
        days = sorted(d for kk, d in rows if kk == k)
        runs, start = [], days[0]
        for d, after in zip(days, [*days[1:], None]):
            if after is None or after - d > 5:
                runs.append((start, d))
                start = after
        mine = {r["day"]: r for r in out if r["k"] == k}
        assert sorted(mine) == [d for a, z in runs for d in range(a, z + 1)]
        for a, z in runs:
            for d in range(a, z + 1):
                for n in (1, 7, 13, 30, 64):
                    assert mine[d][f"v_{n}"] == sum(rows.get((k, x)) or 0.0 for x in range(max(a, d - n + 1), d + 1))


def test_trailing_of_nothing(spark):
    none = spark.createDataFrame([], DAILY).drop("run")
    assert trailing(every_day(none, by=["k"], day="day", values=["v"]), by=["k"], day="day", values=["v"], days=[7]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=0, max_size=60))
def test_impute_fills_all_and_keeps_readings(inside):
    x = np.array([1.0, *[np.nan if v is None else v for v in inside], 2.0])
    out, _ = impute(x)
    assert np.isfinite(out).all()
    assert (out[~np.isnan(x)] == x[~np.isnan(x)]).all()


def test_impute_recovers_a_smooth_series():
    t = np.arange(150)
    whole = 50 + 0.1 * t + 5 * np.sin(t / 6)
    held = whole.copy()
    held[[20, 21, 22, 23, 24, 60, 61, 62, 100, 101, 102, 103]] = np.nan
    lines = np.interp(t, t[~np.isnan(held)], held[~np.isnan(held)])
    assert np.abs(impute(held)[0] - whole).max() < 0.3 * np.abs(lines - whole).max()


READINGS = "k string, at timestamp, x double, week long"


def test_grid_runs_and_marks(spark):
    monday = datetime(2024, 1, 1)
    at = lambda d: monday + timedelta(days=d)
    rows = [("a", at(0), 1.0, 0), ("a", at(3), 3.0, 0), ("a", at(30), 4.0, 0), ("a", at(86), 5.0, 0), ("a", at(86 + 57), 6.0, 0), ("b", at(6.9), 7.0, 0), (None, at(0), 1.0, 0), ("a", None, 1.0, 0), ("a", at(12), None, 0)]
    df = spark.createDataFrame(rows, READINGS)
    out = weekly_grid(df, by=["k"], at="at", value="x").orderBy("k", "run", "week").collect()
    first = min(r["week"] for r in out)
    a0 = [(r["week"] - first, r["filled"]) for r in out if r["k"] == "a" and r["run"] == 0]
    assert a0 == [(w, w not in (0, 4, 12)) for w in range(13)]
    assert [(r["week"] - first, r["value"]) for r in out if r["k"] == "a" and r["run"] == 1] == [(20, 6.0)]
    assert [(r["week"] - first, r["value"], r["readings"]) for r in out if r["k"] == "b"] == [(0, 7.0, 1)]
    assert [r["value"] for r in out if r["k"] == "a" and r["week"] == first] == [2.0]
    assert weekly_grid(df.limit(0), by=["k"], at="at", value="x").count() == 0


def test_usable(spark):
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), float("inf"), 0.0, -5.0, 99999.0, 12.0)], "x double")
    assert [r[0] for r in df.select(usable(F.col("x"), but=0.0, below_size=1e4)).collect()] == [None, None, None, None, -5.0, None, 12.0]
    assert [r[0] for r in df.select(usable(F.col("x"), at_least=0.0)).collect()] == [None, None, None, None, None, 99999.0, 12.0]


def test_rounds_go_on_until_they_settle_and_say_so():
    t = np.arange(120.0)
    whole = np.sin(t / 9) + 0.02 * t
    held = whole.copy()
    held[40:47] = np.nan
    out, settled = impute(held)
    again, _ = impute(held, rounds=20_000)
    assert settled and np.abs(out - again).max() < 1e-4
    _, cut_short = impute(held, rounds=3)
    assert not cut_short


def test_filled_weeks_are_nearer_to_the_truth_than_straight_lines():
    rng = np.random.default_rng(2)
    filled = straight = 0.0
    for k in range(20):
        t = np.arange(150.0)
        whole = 10 + np.sin(t / (5 + k / 4)) + 0.05 * rng.normal(size=150)
        held = whole.copy()
        held[60:68] = np.nan
        out, _ = impute(held)
        lines = np.interp(t, t[~np.isnan(held)], held[~np.isnan(held)])
        filled += np.abs(out - whole)[60:68].mean()
        straight += np.abs(lines - whole)[60:68].mean()
    assert filled < 0.7 * straight
