import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import evaluation as ev
from tidewell.operators.asof import asof, asof_nearest
from tidewell.operators.latest import compare, latest, preserving, row_hash, set_hash, upsert
from tidewell.operators.series import correlation, percent_rank_average, rolling, rolling_correlation, winsorize, z_score

T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, t timestamp, i long", "k string, rt timestamp, id long, v double"


def sides(seed=1):
    rng = random.Random(seed)
    when = lambda: T0 + timedelta(hours=rng.randrange(2000))
    left = [(rng.choice(["a", "a", "b", None]), when() if i % 19 else None, i) for i in range(200)]
    right = [(rng.choice(["a", "b", None]), when() if i % 13 else None, i, rng.choice([None, 1.0, 2.0])) for i in range(120)]
    return left, right


def brute(left, right, forward=False):
    out = {}
    for k, t, i in left:
        able = [(r[1], r[2], r[3]) for r in right if k is not None and r[0] == k and t and r[1] and (r[1] >= t if forward else r[1] <= t)]
        if not able:
            out[i] = (None, None, None)
            continue
        at = min(r[0] for r in able) if forward else max(r[0] for r in able)
        out[i] = max(r for r in able if r[0] == at)[:1] + max((r[1], r[2]) for r in able if r[0] == at)
    return out


def test_asof_both_ways(spark):
    left, right = sides()
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for forward in (False, True):
        for width in (2, 364):
            out = asof(a, b, by=["k"], at="t", right_at="rt", carry=["id", "v"], tie=["id"], forward=forward, shard_days=width)
            assert {r["i"]: (r["matched_at"], r["id"], r["v"]) for r in out.collect()} == brute(left, right, forward)


def test_nearest_prefers_earlier_on_ties(spark):
    a = spark.createDataFrame([("a", T0, 1), ("a", T0 + timedelta(days=9), 2)], LEFT)
    b = spark.createDataFrame([("a", T0 - timedelta(hours=6), 1, 1.0), ("a", T0 + timedelta(hours=6), 2, 2.0)], RIGHT)
    out = asof_nearest(a, b, by=["k"], at="t", right_at="rt", carry=["id"], tie=["id"], tolerance="1 day")
    assert {r["i"]: r["id"] for r in out.collect()} == {1: 1, 2: None}
    assert asof(a, b.limit(0), by=["k"], at="t", right_at="rt", carry=["id"], tie=["id"]).where("id is null").count() == 2


def test_latest_upsert_preserving(spark):
    s = "k string, o long, x double, id long"
    df = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 2, None, 2), ("b", None, 1.0, 3), (None, 1, 2.0, 4), (None, 1, 3.0, 5)], s)
    assert {(r["k"], r["id"]) for r in latest(df, by=["k"], order=["o", "id"]).collect()} == {("a", 2), ("b", 3), (None, 5)}
    kept = {r["k"]: (r["id"], r["x"]) for r in preserving(df, by=["k"], order=["o", "id"], keep=["x"]).collect()}
    assert kept == {"a": (2, 5.0), "b": (3, 1.0), None: (5, 3.0)}
    new = spark.createDataFrame([("a", 3, 9.0, 6), ("c", 1, 1.0, 7)], s)
    once = upsert(latest(df, by=["k"], order=["o", "id"]), new, by=["k"], order=["o"])
    twice = upsert(once, new, by=["k"], order=["o"])
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(once) == rows(twice) and once.count() == 4


def test_compare_and_hashes(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k long, v double")
    b = spark.createDataFrame([(1, 1.0000001), (2, 2.5), (4, 4.0)], "k long, v double")
    assert {(r["k"], r["kind"]) for r in compare(a, b, by=["k"], tolerances={"v": 1e-3}).collect()} == {(2, "differs"), (3, "left_only"), (4, "right_only")}
    h = lambda d: d.agg(set_hash(row_hash(d, ["k", "v"]))).first()[0]
    assert h(a) == h(a.orderBy(F.desc("k"))) != h(b)


def test_ranks_scores_and_clips(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("d", None), ("d", 3.0)], "d string, x double")
    assert sorted(r[0] or -1 for r in df.select(percent_rank_average("x", ["d"])).collect()) == [-1, 0.5, 0.5, 1.0]
    flat = spark.createDataFrame([("d", 2.0), ("d", 2.0)], "d string, x double")
    assert [r[0] for r in flat.select(z_score("x", ["d"])).collect()] == [0.0, 0.0]
    many = spark.createDataFrame([("d", float(i)) for i in range(101)] + [("d", None)], "d string, x double")
    clipped = [r["x"] for r in winsorize(many, ["x"], ["d"]).collect()]
    assert clipped.count(None) == 1 and min(x for x in clipped if x is not None) == 1.0 and max(x for x in clipped if x is not None) == 99.0


def test_full_windows_only(spark):
    df = spark.createDataFrame([(i, float(i) if i != 3 else None) for i in range(8)], "t long, x double")
    w = Window.partitionBy(F.lit(1)).orderBy("t")
    assert [r[0] for r in df.select(rolling(F.avg("x"), w, 3, "x")).collect()] == [None, None, 1.0, None, None, None, 5.0, 6.0]


def test_correlation_of_flat_and_partial_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 2.0, 4.0), ("a", 3, 3.0, None), ("a", 4, 4.0, 9.0), ("flat", 1, 1.0, 2.0), ("flat", 2, 1.0, 3.0), ("one", 1, 1.0, 1.0)], "k string, t long, x double, y double")
    out = {r["k"]: r["c"] for r in df.groupBy("k").agg(correlation("x", "y").alias("c")).collect()}
    assert abs(out["a"] - np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1]) < 1e-12 and out["flat"] is None and out["one"] is None
    rolled = [r[0] for r in df.where("k = 'flat'").select(rolling_correlation("x", "y", Window.partitionBy("k").orderBy("t"), 2)).collect()]
    assert rolled == [None, None]


def test_performance_and_least_squares(spark):
    r = [("p", i, x) for i, x in enumerate([0.1, -0.05, 0.02, -0.1, 0.2])]
    row = ev.performance(spark.createDataFrame(r, "p string, t long, r double"), by=["p"], order="t", ret="r").first()
    grown = np.cumprod([1 + x[2] for x in r])
    peak = np.maximum(np.maximum.accumulate(grown), 1)
    assert abs(row["max_drawdown"] - (grown / peak - 1).min()) < 1e-7 and abs(row["total_return"] - (grown[-1] - 1)) < 1e-7
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([("g", *map(float, a), float(b)) for a, b in zip(x, y)] + [("few", 1.0, 1.0, 1.0)], "g string, x1 double, x2 double, y double")
    out = {r["g"]: r for r in ev.least_squares(df, by=["g"], y="y", xs=["x1", "x2"]).collect()}
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)
    np.testing.assert_allclose([out["g"]["beta_intercept"], out["g"]["beta_x1"], out["g"]["beta_x2"]], want, rtol=1e-6)
    assert out["few"]["beta_x1"] is None and out["g"]["r2"] > 0.99
    centred = x - x.mean(axis=0)
    slopes = np.linalg.solve(centred.T @ centred + 50 * np.eye(2), centred.T @ (y - y.mean()))
    row = ev.least_squares(df, by=["g"], y="y", xs=["x1", "x2"], ridge=50.0).where("g = 'g'").first()
    np.testing.assert_allclose([row["beta_x1"], row["beta_x2"]], slopes, rtol=1e-6)


def test_positions_fold(spark):
    fills = [("a", 1, 10.0, 150.0), ("a", 2, -3.0, 160.0), ("b", 1, -10.0, 100.0), ("b", 2, 10.0, 90.0), ("c", 1, 5.0, 10.0), ("c", 2, -8.0, 12.0)]
    out = {r["k"]: (r["quantity"], r["average_cost"], r["realised"]) for r in ev.fold_positions(spark.createDataFrame(fills, "k string, o long, q double, p double"), by=["k"], order="o", quantity="q", price="p").collect()}
    assert out == {"a": (7.0, 150.0, 30.0), "b": (0.0, 0.0, 100.0), "c": (-3.0, 12.0, 10.0)}


def test_statistics():
    assert abs(ev.expected_best_sharpe(3, float(np.std([0.5, 1.0, 1.5], ddof=1))) - 0.426) < 0.05
    assert ev.probabilistic_sharpe(0.0, 100, 0, 3) == 0.5 and ev.probabilistic_sharpe(1.0, 1, 0, 3) is None
    folds = ev.walk_forward(100, 4, test=10, purge=5)
    assert [(f[0].stop, f[1].start, f[1].stop) for f in folds] == [(55, 60, 70), (65, 70, 80), (75, 80, 90), (85, 90, 100)]
    rng = np.random.default_rng(1)
    good = rng.normal(size=(160, 6)) * 0.01
    good[:, 2] += 0.02
    assert ev.backtest_overfitting(good) < 0.05 < ev.backtest_overfitting(rng.normal(size=(160, 20)))
    assert ev.augmented_dickey_fuller(rng.normal(size=300)) < -8 < -3 < ev.augmented_dickey_fuller(np.cumsum(rng.normal(size=300)))
    assert ev.augmented_dickey_fuller(np.ones(50)) is None
