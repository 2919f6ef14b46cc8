"""Evaluation over every return and every training day."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewell import plans
from tidewell.plans.books import walk_forward_fits

SCHEMA = "bar_id long, timestamp timestamp, symbol string, open double, high double, low double, close double, volume long, vwap double, trade_count long, ingested_at timestamp"
T0 = datetime(2024, 1, 1)
DAYS = 130
SYMBOLS = ("A", "B", "C", "D")


@pytest.fixture(scope="module")
def closes():
    """Four symbols a day each; A falls by three fifths at once and stays there, B rises to two and a half times as much."""
    rng = np.random.default_rng(5)
    moves = rng.normal(0, 0.01, (len(SYMBOLS), DAYS))
    moves[0, 60], moves[1, 90] = -0.6, 1.5
    return 100 * np.cumprod(1 + moves, axis=1)


@pytest.fixture(scope="module")
def folder(spark, closes, tmp_path_factory):
    rows = []
    for i, s in enumerate(SYMBOLS):
        for d in range(DAYS):
            at, c = T0 + timedelta(days=d), float(closes[i, d])
            rows.append((i * DAYS + d, at, s, c, c, c, c, 1000, c, 1, at))
    to = tmp_path_factory.mktemp("bars")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{to}/raw_alpaca_equity_ohlcv.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["factor_fit", "sharpe_intervals"])
def test_large_returns_count(spark, folder, name):
    got = {r["symbol"]: r["n"] for r in plans.queries()[name](spark, folder).collect()}
    assert got == dict.fromkeys(SYMBOLS, DAYS - 1)


def test_sharpe_holds_the_crash(spark, folder, closes):
    got = {r["symbol"]: r["sharpe"] for r in plans.queries()["sharpe_intervals"](spark, folder).collect()}
    ret = closes[0, 1:] / closes[0, :-1] - 1
    assert got["A"] == pytest.approx(ret.mean() / ret.std(ddof=1) * np.sqrt(252))


def test_large_returns_are_tested_on(spark, folder):
    tested = {r["month"]: r["tested"] for r in plans.queries()["walk_forward_scores"](spark, folder).collect()}
    assert tested["2024-03"] == 31 * len(SYMBOLS)


def test_only_the_gap_before_the_test_is_purged(spark):
    """Daily rows of January to April, one of them known only in March: which rows each month's fit takes."""
    days = [T0 + timedelta(days=d) for d in range(31 + 29 + 31 + 30)]
    rows = [(d, d.strftime("%Y-%m"), i % 7 / 7, i % 5 / 100, d + timedelta(days=1)) for i, d in enumerate(days)]
    rows[10] = (*rows[10][:4], datetime(2024, 3, 2))
    m = spark.createDataFrame(rows, "timestamp timestamp, month string, p double, fwd double, fwd_at timestamp")
    got = {r["month"]: r for r in walk_forward_fits(m).collect()}
    assert {k: r["trained"] for k, r in got.items()} == {"2024-02": 26 - 1, "2024-03": 31 + 24 - 1, "2024-04": 31 + 29 + 26}
    p, y = (np.array([r[i] for r in rows if r[0] <= datetime(2024, 3, 26)]) for i in (2, 3))
    want = ((p - p.mean()) * (y - y.mean())).sum() / (((p - p.mean()) ** 2).sum() + 10)
    assert got["2024-04"]["slope"] == pytest.approx(want)


def test_walk_forward_trains_on_month_ends(spark, folder):
    trained = {r["month"]: r["trained"] for r in plans.queries()["walk_forward_scores"](spark, folder).collect()}
    assert trained == {"2024-03": (10 + 24) * len(SYMBOLS), "2024-04": (10 + 29 + 26) * len(SYMBOLS), "2024-05": (10 + 29 + 31 + 25) * len(SYMBOLS)}
