"""Stateful streams: positions kept fill by fill, silent sources, and joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POSITION = "key string, fills long, quantity double, average_cost double, realised double"
HELD = "fills long, quantity double, average_cost double, realised double, last string"


def fold(state: tuple[float, float, float], quantity: float, price: float) -> tuple[float, float, float]:
    """(quantity, average cost, realised gain) after one more fill: the same rule as for a table of fills."""
    held, cost, gain = state
    after = held + quantity
    if held == 0 or (held > 0) == (quantity > 0):
        return after, ((cost * abs(held) + price * abs(quantity)) / abs(after) if after else 0.0), gain
    closed = min(abs(held), abs(quantity)) * (1 if held > 0 else -1)
    gain += closed * (price - cost)
    if after == 0:
        return 0.0, 0.0, gain
    return after, (cost if (after > 0) == (held > 0) else price), gain


def running_positions(fills: DataFrame, *, key: str, order: str, quantity: str, price: str) -> DataFrame:
    """Each key's position after every batch that has fills of it: key, fills, quantity, average_cost, realised.

    What is kept per key is four numbers and the order of the last fill; a fill whose order isn't above it was seen before and is
    left out, so a repeated delivery changes nothing. Fills of a batch are taken in their order; order must sort as text.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fills_, q, c, g, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, "")
        rows = pd.concat(list(frames)).sort_values("o")
        for o, dq, p in zip(rows["o"], rows["q"], rows["p"]):
            if o > last and pd.notna(dq) and pd.notna(p):
                q, c, g = fold((q, c, g), float(dq), float(p))
                fills_, last = fills_ + 1, o
        state.update((fills_, q, c, g, last))
        yield pd.DataFrame({"key": [k[0]], "fills": [fills_], "quantity": [q], "average_cost": [c], "realised": [g]})

    held = fills.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("string").alias("o"), F.col(quantity).cast("double").alias("q"), F.col(price).cast("double").alias("p"))
    return held.groupBy("key").applyInPandasWithState(step, POSITION, HELD, "update", GroupStateTimeout.NoTimeout)


def silent(beats: DataFrame, *, key: str, at: str, after: str = "180 seconds", late: str = "10 seconds") -> DataFrame:
    """Keys that have sent nothing for longer than after, by the stream's own time: key and last_at, once for each silence.

    A key's state is the time of its last beat; a timer set after it fires when the watermark passes.
    """
    wait = int(pd.Timedelta(after).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_at": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(f["at"].max().timestamp() * 1000) for f in frames)
        last = max(newest, state.get[0] if state.exists else newest)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    held = beats.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).alias("at")).withWatermark("at", late)
    return held.groupBy("key").applyInPandasWithState(step, "key string, last_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def matched(left: DataFrame, right: DataFrame, *, key: str, left_at: str, right_at: str, within: str = "1 hour", late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of two streams with the same key whose right time is at most within after the left one. The bounds let old rows leave the state; how is inner or leftOuter."""
    a = left.withWatermark(left_at, late).alias("a")
    b = right.withWatermark(right_at, late).alias("b")
    close = (F.col(f"b.{right_at}") >= F.col(f"a.{left_at}")) & (F.col(f"b.{right_at}") <= F.col(f"a.{left_at}") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & close, how)
