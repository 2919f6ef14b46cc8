import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.operators.persistent_tree import PersistentTree, latest_known

rows = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(0, 20), st.integers(0, 5)), max_size=40)
probes = st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 21), st.integers(-1, 21)), max_size=20)


@settings(max_examples=200, deadline=None)
@given(rows, probes)
def test_latest_known_equals_brute_force(items, asked):
    i = np.array(items, np.int64).reshape(-1, 4)
    p = np.array(asked, np.int64).reshape(-1, 3)
    ids = np.arange(len(i))
    found = latest_known(i[:, 0], i[:, 1], i[:, 2], (i[:, 3], ids), p[:, 0], p[:, 1], p[:, 2])
    for k, (shard, time, key) in enumerate(asked):
        seen = [(x[2], x[3], n) for n, x in enumerate(items) if x[0] == shard and x[1] <= time and x[2] <= key]
        assert found[k] == (max(seen)[2] if seen else -1)


def test_old_versions_stay():
    tree = PersistentTree(np.array([2, 0, 3, 1]))
    everything = np.full(4, 3)
    assert tree.floor(np.arange(4), everything).tolist() == [2, 2, 3, 3]
    assert tree.floor(np.arange(4), np.full(4, 1)).tolist() == [-1, 0, 0, 1]
    assert tree.floor(np.array([-1]), np.array([3])).tolist() == [-1]


def test_empty_and_single():
    none = np.empty(0, np.int64)
    assert latest_known(none, none, none, (none, none), np.array([1]), np.array([1]), np.array([1])).tolist() == [-1]
    assert PersistentTree(np.array([0])).floor(np.array([0]), np.array([0])).tolist() == [0]
