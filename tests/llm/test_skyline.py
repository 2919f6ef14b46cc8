import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.functions import fiscal_period, number
from tidewell.llm.skyline import candidates, representatives

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, g string, at timestamp, seen timestamp, trusted boolean, a double, b double, c double, n long"
FIELDS = ("a", "b", "c")


def args():
    return dict(group=["g"], row_id="id", recency=[F.col("at"), F.col("seen")], trust=F.col("trusted").cast("int"), fields={f: number(f) for f in FIELDS})


def some_rows(count=300):
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), 1.0, 2.0, 3.0])
    when = lambda: T0 + timedelta(days=rng.randrange(8))
    return [(i, rng.choice(["x", "x", "y", "z", None]), when(), rng.choice([None, when()]), rng.random() < 0.7, value(), value(), value(), 0) for i in range(count)]


def test_each_field_comes_from_the_newest_trusted_row_that_serves_it(spark):
    rows = some_rows()
    rows += rows[:10]
    out = {r["g"]: r for r in representatives(spark.createDataFrame(rows, SCHEMA), **args(), least_trust=1).collect()}
    assert set(out) == {r[1] for r in rows}
    for g, r in out.items():
        mine = [x for x in rows if x[1] == g]
        assert r["n"] == len(mine)
        for i, f in enumerate(FIELDS):
            able = [(x[2], x[3] or datetime.min, x[0], x[5 + i]) for x in mine if x[4] and x[5 + i] is not None and x[5 + i] == x[5 + i]]
            assert r[f] == (max(able)[3] if able else None)


def test_layers_are_those_of_peeling(spark):
    rows = some_rows(60)
    for r in candidates(spark.createDataFrame(rows, SCHEMA), **args()).collect():
        left = {i: (c["mask"], c["trust"], (c["best"]["r0"], c["best"]["r1"] or datetime.min, c["best"]["row"])) for i, c in enumerate(r["cands"])}
        layer = 1
        while left:
            below = lambda i: any(j != i and left[j][0] & left[i][0] == left[i][0] and left[j][1] >= left[i][1] and left[j][2] >= left[i][2] for j in left)  # noqa: E731, B023
            top = [i for i in left if not below(i)]
            assert all(r["cands"][i]["layer"] == layer for i in top)
            for i in top:
                del left[i]
            layer += 1


def test_empty_and_untrusted(spark):
    assert representatives(spark.createDataFrame([], SCHEMA), **args()).count() == 0
    r = representatives(spark.createDataFrame([(1, "x", T0, None, False, 1.0, None, None, 0)], SCHEMA), **args(), least_trust=1).first()
    assert (r["id"], r["a"], r["n"]) == (None, None, 1)


def test_fiscal_periods(spark):
    told = {"2021-Q3": "2021-Q3", " q1 2022": "2022-Q1", "1Q22": "2022-Q1", "FY2023 Q4": "2023-Q4", "2022FY": "2022-FY", "fy21": "2021-FY", "2023q2 ": "2023-Q2", "4Q23": "2023-Q4", "FY 2022": "2022-FY", "Q322": "2022-Q3", "soon": None, "": None}
    df = spark.createDataFrame([(k,) for k in told], "p string").select("p", fiscal_period("p").alias("f"))
    assert {r["p"]: r["f"] for r in df.collect()} == told


def test_layers_against_their_definition():
    import numpy as np

    from tidewell.llm.skyline import layers_of

    rng = random.Random(5)
    for _ in range(50):
        masks = [rng.randrange(16) for _ in range(rng.randrange(12))]
        trusts = [rng.randrange(3) for _ in masks]
        left, want, layer = list(range(len(masks))), [0] * len(masks), 1
        above = lambda d, c: d < c and masks[d] & masks[c] == masks[c] and trusts[d] >= trusts[c]
        while left:
            top = [c for c in left if not any(above(d, c) for d in left)]
            for c in top:
                want[c] = layer
            left, layer = [c for c in left if c not in top], layer + 1
        assert layers_of(np.array(masks, np.int64), np.array(trusts, np.int64)).tolist() == want


def test_thousands_of_candidates_in_one_group():
    import time

    import numpy as np

    from tidewell.llm.skyline import layers_of

    began = time.perf_counter()
    masks = np.random.default_rng(0).permutation(2**14).astype(np.int64)
    assert layers_of(masks, np.ones(2**14, np.int64)).max() > 1
    assert time.perf_counter() - began < 20
