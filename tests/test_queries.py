"""Every query against its SQL over the smallest tables, and the driver's contract."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidewell import plans

DATA = os.environ.get("TIDEWELL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df: pd.DataFrame) -> Counter:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, pd.Timestamp):
            return str(v.tz_localize(None) if v.tzinfo else v)
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    if name in plans.oracles():
        want = duck.execute(plans.oracles()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["bar_id", "metric_id", "shares_outstanding", "fund_id", "revenue", "net_income"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for f in ("p1_found", "p3_found", "p4_found", "p5_found"):
        assert f in entry.queries()
