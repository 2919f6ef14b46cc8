import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.operators.spikes import MOVES, START, day_contexts, flag_bars, forward_backward

SCHEMA = "bar_id long, symbol string, timestamp timestamp, ingested_at timestamp, open double, high double, low double, close double, volume long, day string, row string, source string"
T0 = datetime(2024, 1, 1)


def series(symbol, n, first_id, seed, level=100.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        level *= 1 + rng.gauss(0, 0.01)
        o = level * (1 + rng.gauss(0, 0.002))
        at = T0 + timedelta(days=i)
        rows.append([first_id + i, symbol, at, at + timedelta(hours=22), o, max(o, level) * 1.003, min(o, level) * 0.997, level, int(1e6 * np.exp(rng.gauss(0, 0.35))), "d", "r", "s"])
    return rows


def flags(spark, rows):
    out = flag_bars(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), row_id="bar_id", source="symbol", at="timestamp", ingested="ingested_at").collect()
    assert len(out) == len(rows)
    return {r["bar_id"]: r for r in out}


def test_kinds_of_cases(spark):
    rows = series("A", 200, 0, 1)
    rows[50][7] *= 1.4
    rows[50][5] = rows[50][7] * 1.01
    rows[80][8] *= 300
    rows[100][5] = 0.0
    rows[110][8] = -5
    for i in range(121, 127):
        rows[i][4:8] = rows[120][4:8]
    for i in range(140, 145):
        rows[i][4:8] = rows[140][4:8]
    for i in range(160, 200):
        rows[i][4:8] = [x / 2 for x in rows[i][4:8]]
    for i in range(30, 34):
        rows[i][8] *= 20
    rows[170][7] = None
    rows += series("B", 40, 1000, 2)
    out = flags(spark, rows)
    assert {k for k, r in out.items() if r["flagged"]} == {50, 80, 100, 110, *range(120, 127)}
    assert out[50]["is_spike"] and out[80]["is_spike"] and out[100]["is_impossible"] and out[123]["is_stuck"]


def test_copies_are_cases_and_repairs_are_not(spark):
    rows = series("A", 100, 0, 3)
    good = list(rows[40])
    rows[40][4:8] = [x * 10 for x in rows[40][4:8]]
    copy, repair = list(rows[40]), good
    copy[0], copy[3] = 900, copy[3] + timedelta(hours=1)
    repair[0], repair[3] = 901, repair[3] + timedelta(hours=2)
    out = flags(spark, [*rows, copy, repair])
    assert {k for k, r in out.items() if r["flagged"]} == {40, 900}


def test_a_standing_bar_in_a_middle_delivery(spark):
    """On one day of the run the bar comes between a null and a revised delivery, on another after a null one."""
    rows = series("A", 100, 0, 7)
    for i in range(51, 56):
        rows[i][4:8] = rows[50][4:8]
    more = []
    for at, bar_id, hours, null in ((52, 900, -1, True), (52, 901, 1, False), (54, 902, 1, True)):
        other = list(rows[at])
        other[0], other[3] = bar_id, other[3] + timedelta(hours=hours)
        other[4:8] = [None] * 4 if null else [x * 1.004 for x in other[4:8]]
        more.append(other)
    out = flags(spark, [*rows, *more])
    assert {k for k, r in out.items() if r["flagged"]} == set(range(50, 56))


def test_volume_that_mounts_during_a_day_is_fine(spark):
    rows = series("A", 60, 0, 4)
    more = []
    for i, r in enumerate(rows):
        for k in range(5):
            early = list(r)
            early[0], early[3], early[8] = 1000 + 10 * i + k, r[3] - timedelta(hours=20 - 3 * k), r[8] * (k + 1) // 60
            more.append(early)
    assert not any(r["flagged"] for r in flags(spark, rows + more).values())


def test_low_volumes_of_a_day_that_does_not_mount(spark):
    """Day 30 holds one low volume twice, day 45 a low volume that a later delivery repairs."""
    rows = series("A", 80, 0, 8)
    rows[30][8], repair = 3, list(rows[45])
    copy = list(rows[30])
    copy[0], copy[3] = 900, copy[3] + timedelta(hours=1)
    rows[45][8] = 3
    repair[0], repair[3] = 901, repair[3] + timedelta(hours=1)
    assert {k for k, r in flags(spark, [*rows, copy, repair]).items() if r["flagged"]} == {30, 900, 45}


def test_a_price_at_which_the_next_bar_opens_is_real(spark):
    rows = series("A", 100, 0, 6)
    for r, at, factor in ((rows[40], 4, 1.0), (rows[40], 7, 1.3), (rows[40], 5, 1.31), (rows[41], 4, 1.3), (rows[41], 5, 1.31), (rows[70], 7, 1.3), (rows[70], 5, 1.31)):
        r[at] *= factor
    assert {k for k, r in flags(spark, rows).items() if r["flagged"]} == {70}


def test_nulls_short_series_and_empty(spark):
    odd = [[1, None, T0, None, 1.0, 1.0, 1.0, 1.0, 1, "", "", ""], [2, "A", None, None, 1.0, 1.0, 1.0, -1.0, 1, "", "", ""], [3, "A", T0, None, None, None, None, None, None, "", "", ""], [4, "B", T0, None, float("nan"), 2.0, 1.0, 1.5, 0, "", "", ""]]
    assert {k for k, r in flags(spark, odd).items() if r["flagged"]} == {2}
    assert flag_bars(spark.createDataFrame([], SCHEMA), row_id="bar_id", source="symbol", at="timestamp", ingested="ingested_at").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(0.01, 5), min_size=4, max_size=4), min_size=1, max_size=6))
def test_forward_backward_equals_enumeration(densities):
    import itertools

    d = np.array(densities)
    n = len(d)
    ahead, behind, _ = forward_backward(np.log(d), np.array([n]), MOVES[None])
    got = ahead * d * behind
    got /= got.sum(axis=1, keepdims=True)
    want = np.zeros((n, 4))
    for path in itertools.product(range(4), repeat=n):
        p = START[path[0]] * d[0, path[0]]
        for i in range(1, n):
            p *= MOVES[path[i - 1], path[i]] * d[i, path[i]]
        for i, s in enumerate(path):
            want[i, s] += p
    np.testing.assert_allclose(got, want / want.sum(axis=1, keepdims=True), rtol=1e-6)


def _daily(sources):
    rng = np.random.default_rng(4)
    parts = []
    for name, days in sources:
        close = 4 + np.cumsum(rng.normal(0, 0.02, days))
        parts.append(pd.DataFrame({"source": name, "day": np.arange(days), "close": close, "high": close + 0.01, "volume": rng.normal(10, 0.4, days), "open": close, "keys": [[] for _ in range(days)], "mounting": False, "all_bad": False}))
    return pd.concat(parts, ignore_index=True)


def test_memory_goes_with_the_rows_and_not_with_the_longest_calendar():
    import time
    import tracemalloc

    f = _daily([("a", 6000)] + [(f"s{i:05}", 1) for i in range(3000)])
    tracemalloc.start()
    began = time.perf_counter()
    out = day_contexts(f)
    assert len(out) == len(f) and time.perf_counter() - began < 60
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_a_source_gets_the_same_whoever_shares_its_batch():
    f = _daily([("a", 200), ("b", 150), ("c", 30)])
    f.loc[50, "close"] += 1.0
    f.loc[[220, 300], "volume"] += 6.0
    together = day_contexts(f)
    alone = pd.concat([day_contexts(g.reset_index(drop=True)) for _, g in f.groupby("source")], ignore_index=True)
    numbers = [c for c in together if c.startswith(("w_", "before_", "after_", "spread_"))]
    assert np.allclose(together[numbers].to_numpy(float), alone[numbers].to_numpy(float), equal_nan=True)


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    moves = rng.dirichlet(np.ones(4), (2, 4))
    lengths, logs = np.array([3, 2]), rng.normal(0, 1, (5, 4))
    prior, after, counts = forward_backward(logs, lengths, moves)
    for s, (first, n) in enumerate(((0, 3), (3, 2))):
        mass, pairs = np.zeros((n, 4)), np.zeros((4, 4))
        for path in itertools.product(range(4), repeat=n):
            w = START[path[0]] * np.prod([moves[s][a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(logs[first + i, x] for i, x in enumerate(path)))
            for i, x in enumerate(path):
                mass[i, x] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        got = prior[first : first + n] * np.exp(logs[first : first + n]) * after[first : first + n]
        assert np.allclose(got / got.sum(axis=1, keepdims=True), mass / mass.sum(axis=1, keepdims=True))
        assert np.allclose(counts[s], pairs / mass.sum(axis=1)[0])
