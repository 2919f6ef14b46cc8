"""Weights from scores, and their projection onto limits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def capped(raw: np.ndarray, cap: float) -> np.ndarray:
    """Weights in proportion to raw (not negative) that add up to 1 with none above cap; what is cut goes to the rest in equal parts. Equal weights if no cap can hold."""
    w = np.clip(np.nan_to_num(np.asarray(raw, float)), 0, None)
    n = len(w)
    if not n:
        return w
    w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
    if cap * n <= 1:
        return np.full(n, 1 / n)
    for _ in range(n):
        over = w > cap + 1e-12
        if not over.any():
            break
        rest = ~over & (w < cap)
        surplus = (w[over] - cap).sum()
        w[over] = cap
        w[rest] += surplus / rest.sum()
    return w / w.sum()


def rank_weights(scores: DataFrame, *, date: str, key: str, score: str, cap: float = 0.2) -> DataFrame:
    """Long-only weights by rank of score per date: date, key, weight. Null scores get none; ties share their average rank.

    One date's cross-section has a row per key, so it fits a task; dates are spread over tasks.
    """
    held = scores.where(f"{score} is not null and not isnan({score})").select(date, key, score)
    schema = f"{date} {dict(held.dtypes)[date]}, {key} {dict(held.dtypes)[key]}, weight double"

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        return pd.DataFrame({date: f[date], key: f[key], "weight": capped(f[score].rank(method="average").to_numpy(), cap)})

    return held.groupBy(date).applyInPandas(one, schema)


@dataclass(frozen=True)
class Limits:
    """What a book must keep to, as shares of its value; None or the default of a limit leaves it open."""

    symbol: float = 0.2
    gross: float = 1.0
    cash: float = 0.0
    turnover: float | None = None
    net: float | None = None
    leverage: float | None = None
    positions: int | None = None
    top: int | None = None
    top_share: float | None = None
    volatility: float | None = None
    smallest_move: float = 0.0
    #: Above this volatility symbol and gross limits fall by these parts.
    calm: float | None = None
    brake_symbol: float = 0.5
    brake_gross: float = 0.5
    #: Share of a day's trading that a position may take, the least confidence, and the bars that a position is kept at least.
    traded_share: float | None = None
    confidence: float = 0.0
    hold: int = 0


@dataclass
class Today:
    """What is known besides the raw weights: all arrays have one place per key."""

    previous: np.ndarray | None = None
    volatility: float | None = None
    #: Value traded a day in units of the book's value.
    traded: np.ndarray | None = None
    confidence: np.ndarray | None = None
    bars_held: np.ndarray | None = None


def _scaled_to(w: np.ndarray, most: float | None) -> np.ndarray:
    total = w.sum()
    return w * (most / total) if most is not None and total > most and total > 0 else w


def _steps(limits: Limits, today: Today, n: int):
    """The projection's steps in order: a name and what it does to weights. Limits on symbol and gross are those of the day's volatility."""
    wild = limits.calm is not None and today.volatility is not None and today.volatility > limits.calm
    symbol = limits.symbol * (1 - limits.brake_symbol) if wild else limits.symbol
    room = max(min(limits.gross * (1 - limits.brake_gross) if wild else limits.gross, 1 - limits.cash), 0.0)
    before = today.previous

    def target_volatility(w):
        over = limits.volatility and today.volatility and today.volatility > limits.volatility
        return w * (limits.volatility / today.volatility) if over else w

    def turnover(w):
        if before is None or limits.turnover is None:
            return w
        moved = np.abs(w - before).sum()
        if moved > limits.turnover:
            w = np.maximum(before + (w - before) * (limits.turnover / moved), 0.0)
        return _scaled_to(w, room)

    def fewest(w):
        if limits.positions is None or (w > 0).sum() <= limits.positions:
            return w
        w = w.copy()
        w[np.argsort(w, kind="stable")[: n - limits.positions]] = 0.0
        return w

    def concentrated(w):
        if not limits.top or limits.top_share is None or limits.top >= n:
            return w
        top = np.argsort(-w, kind="stable")[: limits.top]
        if w[top].sum() <= limits.top_share:
            return w
        w = w.copy()
        w[top] *= limits.top_share / w[top].sum()
        return w

    def liquid(w):
        if limits.traded_share is None or today.traded is None:
            return w
        return np.where(today.traded > 0, np.minimum(w, limits.traded_share * today.traded), w)

    def sure(w):
        return np.where(today.confidence < limits.confidence, 0.0, w) if today.confidence is not None and limits.confidence > 0 else w

    def held(w):
        if before is None or today.bars_held is None or limits.hold <= 1:
            return w
        young = (today.bars_held > 0) & (today.bars_held < limits.hold) & (before > 0) & (w < before)
        return np.where(young, np.minimum(before, symbol), w)

    def moved_enough(w):
        if before is None:
            return w
        small = np.abs(w - before)
        return np.where((small > 0) & (small < limits.smallest_move) & (w > 0), np.minimum(before, symbol), w)

    def last_check(w):
        return _scaled_to(np.minimum(w, symbol), room)

    # The brakes act on the limits; as a step they are logged and change nothing.
    return wild, (
        ("vol_regime_brakes", lambda w: w), ("volatility_scaling", target_volatility), ("long_only", lambda w: np.maximum(w, 0.0)), ("max_symbol_weight", lambda w: np.minimum(w, symbol)),
        ("max_gross_exposure", lambda w: _scaled_to(w, room)), ("max_daily_turnover", turnover), ("max_net_exposure", lambda w: _scaled_to(w, limits.net)), ("max_leverage", lambda w: _scaled_to(w, limits.leverage)),
        ("max_active_positions", fewest), ("concentration_limit", concentrated), ("max_adv_pct", liquid), ("min_confidence", sure), ("min_holding_period", held), ("minimum_order_threshold", moved_enough),
        ("min_cash", lambda w: _scaled_to(w, 1 - limits.cash)), ("final_validation", last_check),
    )


def project(raw: np.ndarray, limits: Limits, previous: np.ndarray | None = None, volatility: float | None = None, today: Today | None = None, log: list | None = None) -> np.ndarray:
    """raw brought within limits, step by step; what later steps open again the last one closes, but for the turnover, as positions that must
    be held may need more of it. log gets one (step, changed, total before, total after) a step. Missing weights count as none."""
    w = np.nan_to_num(np.asarray(raw, float)).copy()
    day = today or Today(None if previous is None else np.asarray(previous, float), volatility)
    wild, steps = _steps(limits, day, len(w))
    for name, step in steps:
        after = step(w)
        if log is not None:
            log.append((name, bool(wild) if name == "vol_regime_brakes" else not np.array_equal(w, after), float(w.sum()), float(after.sum())))
        w = after
    return w


def project_path(weights: DataFrame, *, book: str, date: str, key: str, weight: str, limits: Limits, log: bool = False) -> DataFrame:
    """project along each book's dates, each date starting from the one before: book, date, key, weight. A key absent on a date has a raw weight of 0.
    log gives the decisions instead: book, date, step, changed, before, after.

    The path depends on itself, so a book is one task; its size is its dates times its keys.
    """
    types = dict(weights.dtypes)
    schema = f"{book} {types[book]}, {date} {types[date]}, " + ("step string, changed boolean, before double, after double" if log else f"{key} {types[key]}, weight double")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        wide = f.pivot_table(index=date, columns=key, values=weight, aggfunc="sum", fill_value=0.0).sort_index()
        previous = np.zeros(wide.shape[1])
        rows, told = [], []
        for day, raw in zip(wide.index, wide.to_numpy(float)):
            steps: list | None = [] if log else None
            previous = project(raw, limits, previous, log=steps)
            rows.append(previous)
            told += [(f[book].iloc[0], day, *step) for step in steps or []]
        if log:
            return pd.DataFrame(told, columns=[book, date, "step", "changed", "before", "after"])
        out = pd.DataFrame(np.array(rows), index=wide.index, columns=wide.columns).stack().rename("weight").reset_index()
        out.insert(0, book, f[book].iloc[0])
        return out[[book, date, key, "weight"]]

    return weights.select(book, date, key, weight).groupBy(book).applyInPandas(one, schema)
