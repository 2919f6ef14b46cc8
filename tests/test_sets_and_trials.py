import pandas as pd
import pytest

from tidewell.functions import date_range
from tidewell.operators.evaluation import deflate, expected_best_sharpe
from tidewell.plans import sets
from tidewell.sources.universe import read_universe


def test_lookbacks():
    assert len(sets.LOOKBACKS) == 47
    assert sets.lookback(sets.PRICES) == 252 and sets.lookback(["ret_5d", "rv_21d"]) == 22 and sets.lookback([]) == 0
    with pytest.raises(KeyError):
        sets.lookback(["nope"])


def test_deflated_sharpes():
    t = pd.DataFrame({"sharpe": [0.5, 1.0, 1.5], "skew": 0.0, "kurtosis": 3.0, "n": 252})
    out = deflate(t)
    assert out["benchmark_sharpe"].iloc[0] == pytest.approx(0.3476, abs=0.005)
    five = deflate(pd.DataFrame({"sharpe": [0.5, 0.8, 1.2, 1.5, 2.0], "skew": 0.0, "kurtosis": 3.0, "n": 252}))
    assert five["benchmark_sharpe"].iloc[0] == pytest.approx(0.6255, abs=0.01)
    assert five["dsr"].iloc[-1] == pytest.approx(0.914, abs=0.01)
    assert deflate(t.head(1))["benchmark_sharpe"].tolist() == [0.0] and len(deflate(t.head(0))) == 0
    assert expected_best_sharpe(1, 2.0) == 0.0


def test_universe_and_days(spark, tmp_path):
    (tmp_path / "u.yml").write_text("symbols:\n  - abc  # the first\n  - 'XY'\n\n- Abc, q\n")
    assert sorted(r["symbol"] for r in read_universe(spark, str(tmp_path / "u.yml")).collect()) == ["ABC", "Q", "XY"]
    df = spark.sql("select explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-02 23:59:59', timestamp'2024-01-03 00:00:00')) as t")
    assert df.where(date_range("t", "2024-01-02", "2024-01-02")).count() == 1 and df.where(date_range("t")).count() == 3 and df.where(date_range("t", until="2024-01-02")).count() == 2
