"""Queries: each takes (spark, sf_dir) and returns a DataFrame; ORACLES hold the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidewell.plans import books, canonical, chains, checks, features, joins, panels, replays, risk, sets, statistics, streams, trials

MODULES = [panels.book, canonical.book, features.book, joins.book, statistics.book, streams.book, books.book, chains.book, risk.book, trials.book, replays.book, sets.book, checks.book]


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracles.items()}
