import random
from datetime import datetime, timedelta

from tidewell.operators.known_at import join_known, known_at
from tidewell.operators.skew import hot_keys, join_spread

ARGS = dict(by="symbol", at="timestamp", valid="timestamp", ingested="ingested_at", row_id="metric_id")
EVENTS = "bar_id long, symbol string, timestamp timestamp, ingested_at string"
ROWS = "metric_id long, symbol string, timestamp timestamp, ingested_at timestamp, v double"
T0 = datetime(2024, 1, 1)


def brute(events, rows):
    out = set()
    for _, s, t, _ in events:
        if s is None or t is None:
            continue
        seen = [(r[2], r[3] or datetime.min, r[0], r[4]) for r in rows if r[1] == s and r[2] is not None and r[2] <= t and (r[3] is None or r[3] <= t)]
        if seen:
            out.add((s, t, max(seen)[2], max(seen)[3]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda n: T0 + timedelta(days=n)
    events = [(i, rng.choice(["A", "A", "A", "B", None]), day(rng.randrange(200)) if i % 17 else None, "x") for i in range(300)]
    rows = []
    for i in range(250):
        at = day(rng.randrange(200))
        late = None if i % 9 == 0 else at + timedelta(days=rng.choice([-3, 0, 1, 40, 150]), hours=rng.randrange(24))
        rows.append((i, rng.choice(["A", "A", "B", "C", None]), at if i % 23 else None, late, rng.random()))
    rows += rows[:20]
    e, r = spark.createDataFrame(events, EVENTS), spark.createDataFrame(rows, ROWS)
    for width in (3, 28, 4000):
        found = known_at(e, r, **ARGS, carry=["v"], shard_days=width)
        assert {tuple(x) for x in found.collect()} == brute(events, rows)
        assert found.count() == len(brute(events, rows))


def test_empty_sides_and_null_keys(spark):
    e = spark.createDataFrame([(1, None, T0, ""), (2, "A", None, ""), (3, "A", T0, "")], EVENTS)
    nothing = spark.createDataFrame([], ROWS)
    assert known_at(e, nothing, **ARGS).count() == 0
    assert known_at(spark.createDataFrame([], EVENTS), nothing, **ARGS).count() == 0


def test_large_ids_keep_their_value(spark):
    big = 2**60 + 1
    e = spark.createDataFrame([(1, "A", T0, "")], EVENTS)
    r = spark.createDataFrame([(big, "A", T0, None, None)], ROWS)
    assert [tuple(x) for x in known_at(e, r, **ARGS, carry=["v"]).collect()] == [("A", T0, big, None)]


def test_hot_entities_are_spread_and_lose_nothing(spark):
    events = [(i, "A" if i % 10 else f"S{i}", T0 + timedelta(days=i % 7), "") for i in range(400)]
    rows = [(i, s, T0, None, 1.0) for i, s in enumerate({x[1] for x in events})]
    e, r = spark.createDataFrame(events, EVENTS), spark.createDataFrame(rows, ROWS)
    assert [tuple(k) for k in hot_keys(e, "symbol", 100).collect()] == [("A", 4)]
    assert hot_keys(spark.createDataFrame([], EVENTS), "symbol", 100).count() == 0
    found = known_at(e, r, **ARGS)
    left = e.select("bar_id", "symbol", "timestamp").unionByName(spark.createDataFrame([(None, T0, 1000)], "symbol string, timestamp timestamp, bar_id long"))
    outer = join_spread(left, found, on=["symbol", "timestamp"], key="symbol", spread="bar_id", how="left", rows_per_task=100)
    assert sorted(x["bar_id"] for x in outer.collect()) == [*range(400), 1000]
    joined = join_known(e.select("bar_id", "symbol", "timestamp"), found, by="symbol", at="timestamp", spread="bar_id")
    assert sorted(x["bar_id"] for x in joined.collect()) == list(range(400))


def test_what_was_known_about_an_earlier_time_takes_corrections_of_the_past(spark):
    rng = random.Random(8)
    when = lambda n: T0 + timedelta(hours=rng.randrange(24 * n))
    attrs = []
    for i in range(500):
        at = when(200)
        attrs.append((i, rng.choice("AAB"), at, rng.choice([None, at, at + timedelta(days=rng.choice([0, 1, 3, 40, 100]))]), float(i)))
    asked = [(i, rng.choice("AB"), when(220), when(220), "") for i in range(400)]
    a = spark.createDataFrame(attrs, "row_id long, symbol string, at timestamp, seen timestamp, v double")
    e = spark.createDataFrame(asked, "bar_id long, symbol string, timestamp timestamp, asked timestamp, v string")
    far = lambda x: x or datetime(1, 1, 1)
    for days, rows in ((28, 200_000), (7, 5), (1, 3)):
        out = known_at(e, a, by="symbol", at="timestamp", as_of="asked", valid="at", ingested="seen", row_id="row_id", carry=["v"], shard_days=days, shard_rows=rows).collect()
        got = {(r["symbol"], r["timestamp"], r["asked"]): r["row_id"] for r in out}
        want = {}
        for _, s, t, v, _ in asked:
            seen = [r for r in attrs if r[1] == s and r[2] <= min(t, v) and far(r[3]) <= t]
            if seen:
                want[s, t, v] = max(seen, key=lambda r: (r[2], far(r[3]), r[0]))[0]
        assert got == want
