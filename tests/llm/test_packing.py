import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import packing
from tidewell.llm.packing import best_configuration, pack, plan_packs, solve


def check_plan(histogram, capacity):
    p = plan_packs(np.array(histogram), capacity)
    room, placed = defaultdict(int), defaultdict(int)
    for i, (length, first, start, each) in enumerate(zip(p.length, p.first, p.pack, p.each)):
        after = p.first[i + 1] if i + 1 < len(p.length) and p.length[i + 1] == length else histogram[length]
        assert first == placed[length] and (after - first) % each == 0
        placed[length] += after - first
        for k in range((after - first) // each):
            room[start + k] += length * each
    assert all(placed[n] == c for n, c in enumerate(histogram) if n)
    assert set(room) == set(range(p.packs)) and max(room.values(), default=0) <= capacity
    return p


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=41))
def test_every_plan_is_whole_and_fits(histogram):
    histogram[0] = 0
    check_plan(histogram, len(histogram) - 1)


def test_plans_leave_little_room():
    rng = np.random.default_rng(0)
    for capacity in (64, 300, 1000):
        lengths = np.minimum(rng.geometric(8 / capacity, 5000), capacity)
        h = np.bincount(lengths, minlength=capacity + 1)
        p = check_plan(h, capacity)
        assert p.packs <= 1.02 * np.ceil(lengths.sum() / capacity) + 1


def best_fit_decreasing(histogram, capacity):
    rooms, packs = np.zeros(capacity + 1, int), 0
    for length in range(capacity, 0, -1):
        for _ in range(int(histogram[length])):
            fits = np.flatnonzero(rooms[length:])
            room = length + fits[0] if len(fits) else capacity
            rooms[room] -= len(fits) > 0
            packs += len(fits) == 0
            rooms[room - length] += 1
    return packs


@pytest.mark.parametrize("count", [100, 1000, 10_000])
@pytest.mark.parametrize("capacity", [256, 1024, 4096])
def test_no_more_packs_than_best_fit_decreasing_and_a_small_gap(count, capacity):
    rng = np.random.default_rng(count)
    lengths = np.minimum(np.exp(rng.normal(4.3, 1.4, count)).astype(int) + 1, capacity)
    h = np.bincount(lengths, minlength=capacity + 1)
    p = check_plan(h, capacity)
    assert p.packs <= best_fit_decreasing(h, capacity)
    assert p.packs <= max(np.ceil(p.bound - 1e-6), 1.0005 * p.bound)


def test_hard_sizes_need_mixed_configurations():
    h = [0] * 101
    h[60], h[40], h[35], h[30] = 300, 300, 200, 100
    assert check_plan(h, 100).packs == 400
    steps, bound = solve(np.bincount([40] * 300 + [60] * 300, minlength=101), 100)
    assert 299 < bound <= 300.001 and sum(s[2] for s in steps) == 300


def test_the_bound_is_learned_where_tokens_do_not_give_it():
    h = np.zeros(101, int)
    h[34], h[33], h[35], h[50] = 1000, 500, 500, 333
    p = check_plan(h, 100)
    assert p.packs == 1042 and 1036 < p.bound <= 1041.5 + 1e-6
    hard = np.bincount(np.random.default_rng(1).integers(200, 500, 2000), minlength=1001)
    assert check_plan(hard, 1000).gap < 0.01


def test_pricing_is_a_bounded_knapsack():
    import itertools

    rng = random.Random(1)
    for _ in range(40):
        n, capacity = rng.randint(1, 4), rng.randint(5, 30)
        sizes, most = np.array(sorted(rng.sample(range(1, 12), n))), np.array([rng.randint(0, 4) for _ in range(n)])
        prices = np.array([rng.random() for _ in range(n)])
        best = max(prices @ np.array(c) for c in itertools.product(*[range(m + 1) for m in most]) if sizes @ np.array(c) <= capacity)
        got = best_configuration(sizes, prices, most, capacity)
        assert (got <= most).all() and sizes @ got <= capacity and abs(prices @ got - best) < 1e-9


@pytest.mark.parametrize("ranked", [50_000, 7])
def test_pack_places_every_token_once(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED_ROWS", ranked)
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 5, 5, 5, 9, 20, 33, 64, 65, 200]) for i in range(250)}
    df = spark.createDataFrame([(i, n, "x", "y") for i, n in sizes.items()] + [(1000, None, "x", "y"), (1001, -4, "x", "y")], "doc_id long, n_tokens long, pack_no string, capacity string")
    out = pack(df, {"small": 20, "big": 64}, row_id="doc_id").collect()
    for name, capacity in (("small", 20), ("big", 64)):
        mine = [r for r in out if r["pack_name"] == name]
        used, docs = defaultdict(int), defaultdict(list)
        for r in mine:
            used[r["pack_no"]] += r["tokens_used"]
            docs[r["doc_id"]].append((r["piece_no"], r["tokens_used"]))
        assert max(used.values()) <= capacity and set(used) == set(range(1, max(used) + 1))
        assert {d: sum(t for _, t in p) for d, p in docs.items()} == sizes | {1000: 0, 1001: 0}
        for d, p in docs.items():
            assert sorted(k for k, _ in p) == list(range(1, len(p) + 1))
            assert len(p) == 1 or (len(p) == -(-sizes[d] // capacity) and sorted(t for _, t in p)[1:] == [capacity] * (len(p) - 1))
        assert max(used) <= 1.1 * -(-sum(sizes.values()) // capacity) + 1


def test_pack_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(none, {"a": 5}, row_id="doc_id").count() == 0
    assert pack(spark.createDataFrame([(1, 2)], none.schema), {}, row_id="doc_id").count() == 0
    with pytest.raises(ValueError):
        pack(none, {"a": 0}, row_id="doc_id")
