import glob
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidewell.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TIDEWELL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).toPandas() is not None


def test_packs_and_clean_set_are_whole(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    packs = QUERIES["p6_packs"](spark, DATA).toPandas()
    assert packs.groupby("pack_name").doc_id.nunique().tolist() == [documents] * 3
    assert QUERIES["p8_found"](spark, DATA).count() + QUERIES["p8_clean"](spark, DATA).count() == documents


def _rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, name):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = QUERIES[name](spark, DATA).toPandas(), c.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
