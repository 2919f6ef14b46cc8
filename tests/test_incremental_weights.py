import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.operators.incremental import advance, changed, fresh_features, reset
from tidewell.operators.weights import Limits, Today, capped, project, project_path, rank_weights
from tidewell.plans import registry

T0 = datetime(2023, 1, 2)


def bars(spark, n=200):
    rng = random.Random(1)
    days = [T0 + timedelta(days=d) for d in range(n * 7 // 5) if (T0 + timedelta(days=d)).weekday() < 5]
    return spark.createDataFrame([(s, d, 100 * np.exp(rng.gauss(0, 0.02)).item()) for s in ("A", "B") for d in days], "symbol string, timestamp timestamp, close double")


def test_incremental_equals_full(spark):
    b = bars(spark)
    names = ["ret_21d", "rv_21d", "dist_20d_low"]
    full = registry.compute(b, names)
    mark = T0 + timedelta(days=150)
    marks = spark.createDataFrame([("A", mark)], "symbol string, watermark timestamp")
    fresh = fresh_features(b, marks, lambda d: registry.compute(d, names), by="symbol", at="timestamp", lookback_rows=registry.lookback(names))
    want = {tuple(r) for r in full.collect() if r["symbol"] == "B" or r["timestamp"] > mark}
    assert {tuple(r) for r in fresh.collect()} == want
    new = {r["symbol"]: r["watermark"] for r in advance(marks, fresh, by="symbol", at="timestamp").collect()}
    last = max(r["timestamp"] for r in b.collect())
    assert new == {"A": last, "B": last}
    cap = spark.createDataFrame([("A", mark + timedelta(days=3))], "symbol string, last_input timestamp")
    assert {r["symbol"]: r["watermark"] for r in advance(marks, fresh, by="symbol", at="timestamp", cap=cap).collect()} == {"A": mark + timedelta(days=3), "B": last}
    assert advance(marks, fresh.limit(0), by="symbol", at="timestamp").collect() == marks.collect()


def test_changed_keys_are_reset(spark):
    s = "k string, hash string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "2")], s), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], s)
    moved = changed(old, new, by="k")
    assert [r["k"] for r in moved.collect()] == ["b"]
    marks = spark.createDataFrame([("a", 1), ("b", 1)], "k string, watermark long")
    assert [r["k"] for r in reset(marks, moved, by="k").collect()] == ["a"]


def test_registry(spark):
    with pytest.raises(KeyError):
        registry.compute(bars(spark), ["nope"])
    with pytest.raises(ValueError):
        registry.feature("ret_1d", 1)(lambda: None)
    assert registry.lookback(["ret_1d", "rv_63d"]) == 64
    a, b = registry.FeatureSet("s", ("x", "y")), registry.FeatureSet("s", ("y", "x"))
    assert a.config_hash() == registry.FeatureSet("s", ("x", "y")).config_hash() != b.config_hash()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12), st.floats(0.05, 1))
def test_capped(raw, cap):
    w = capped(np.array(raw), cap)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert w.max() <= max(cap, 1 / len(w)) + 1e-9


limits = st.builds(Limits, symbol=st.floats(0.05, 1), gross=st.floats(0.2, 1), cash=st.floats(0, 0.3), positions=st.none() | st.integers(1, 5), volatility=st.none() | st.just(0.1), turnover=st.none() | st.floats(0.01, 2))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-1, 2), min_size=1, max_size=9), limits, st.floats(0.01, 0.5))
def test_projection_holds_limits(raw, limit, volatility):
    # Cash is kept out of the whole book: the sum may be no more than gross, nor than 1 less cash.
    w = project(np.array(raw), limit, previous=np.zeros(len(raw)), volatility=volatility)
    assert (w >= 0).all() and w.max() <= limit.symbol + 1e-9 and w.sum() <= min(limit.gross, 1 - limit.cash) + 1e-9
    if limit.turnover is not None:
        assert w.sum() <= limit.turnover + 1e-9
    if limit.positions is not None:
        assert (w > 0).sum() <= limit.positions


def test_weights_over_dates(spark):
    s = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (1, "c", None), (2, "a", 1.0), (2, "b", 2.0)], "d long, k string, s double")
    w = rank_weights(s, date="d", key="k", score="s", cap=0.6)
    assert {(r["d"], r["k"]): round(r["weight"], 6) for r in w.collect()} == {(1, "a"): 0.6, (1, "b"): 0.4, (2, "a"): 0.4, (2, "b"): 0.6}
    from pyspark.sql import functions as F

    path = project_path(w.withColumn("book", F.lit("x")), book="book", date="d", key="k", weight="weight", limits=Limits(symbol=0.6, turnover=0.5)).orderBy("d", "k").collect()
    assert [round(r["weight"], 6) for r in path] == [0.3, 0.2, 0.4, 0.6]
    assert rank_weights(s.limit(0), date="d", key="k", score="s").count() == 0


def test_projection_steps_and_log():
    log = []
    day = Today(previous=np.array([0.1, 0.3, 0.0, 0.2]), volatility=0.4, traded=np.array([1.0, 1.0, 0.1, 1.0]), confidence=np.array([1.0, 1.0, 1.0, 0.2]), bars_held=np.array([9.0, 1.0, 0.0, 9.0]))
    limits = Limits(symbol=0.4, gross=1.0, cash=0.1, calm=0.3, brake_symbol=0.25, brake_gross=0.2, volatility=0.2, traded_share=0.5, confidence=0.5, hold=3, smallest_move=0.02)
    w = project(np.array([0.6, 0.1, 0.4, -0.5]), limits, today=day, log=log)
    # Halved for volatility, cut at nothing, 0.3 and the room of 0.8; the third by its trading, the second held, the fourth out.
    assert np.allclose(w, [0.3, 0.3, 0.05, 0.0])
    assert [name for name, changed, *_ in log if changed] == ["vol_regime_brakes", "volatility_scaling", "long_only", "max_adv_pct", "min_holding_period"]
    assert len(log) == 16
    small = project(np.array([0.105, 0.5]), Limits(symbol=0.4, smallest_move=0.01), previous=np.array([0.1, 0.0]))
    assert np.allclose(small, [0.1, 0.4])
    fewer = project(np.array([0.3, 0.2, 0.1]), Limits(symbol=0.5, positions=2, top=1, top_share=0.25))
    assert np.allclose(fewer, [0.25, 0.2, 0.0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=9), limits, st.floats(0.01, 0.5), st.integers(0, 99))
def test_hard_limits_hold_whatever_was_held(raw, limit, volatility, seed):
    rng = np.random.default_rng(seed)
    n = len(raw)
    day = Today(previous=rng.dirichlet(np.ones(n)), volatility=volatility, bars_held=rng.integers(0, 5, n).astype(float), confidence=rng.random(n), traded=rng.random(n))
    w = project(np.array(raw), replace(limit, hold=3, calm=0.2, traded_share=0.5, confidence=0.3, smallest_move=0.01), today=day)
    assert (w >= 0).all() and w.max() <= limit.symbol + 1e-9 and w.sum() <= min(limit.gross, 1 - limit.cash) + 1e-9
