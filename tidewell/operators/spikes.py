"""Implausible readings in daily bars: a hidden Markov model per source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import day_number
from tidewell.operators.skew import join_spread, spread, whole_groups

NORMAL, SPIKE, STUCK, OUT = range(4)
FIELDS = ("close", "high", "volume")
#: Spread (of the log) that a source is assumed to have until its own bars say otherwise, and the bars this is worth.
PRIOR_SPREAD = {"close": 0.02, "high": 0.02, "volume": 0.5}
PRIOR_BARS = 8
#: Weight and width (in spreads) of the wide part of a normal reading: trading comes in bursts, prices don't.
WIDE = {"volume": (0.01, 1.7)}
#: How much a volume below its neighbours counts: thin days are normal.
THIN = 0.5
#: Density of a bad reading: even over this range of the log.
BAD_RANGE = 16.0
#: Chance of equal bars on two days for a live source and for one that stands still.
SAME = {NORMAL: 1e-5, SPIKE: 1e-5, STUCK: 0.95}
#: Rows from, columns to; and the days that this prior is worth when a source's own rates are learned.
MOVES = np.array([[0.9960, 0.0025, 0.0005, 0.0010], [0.9880, 0.0020, 0.0020, 0.0080], [0.0990, 0.0005, 0.9000, 0.0005], [0.9880, 0.0050, 0.0020, 0.0050]])
PRIOR_DAYS = 2_000.0
START = np.array([0.994, 0.0025, 0.0005, 0.003])
#: A source's rates are learned until none moves by more than LEARNED and the readings left out stay the same; a source whose readings
#: keep changing places ends after LEARN_ROUNDS.
LEARN_ROUNDS, LEARNED = 20, 1e-4
#: Chance that a day has nothing but readings that break hard bounds.
BREAKS = {NORMAL: 1e-12, SPIKE: 1e-12, STUCK: 1e-12, OUT: 1 - 1e-9}
#: A day's volumes mount when readings lie clearly between its least and its most: this much of the squared range in sum.
BETWEEN = 0.1
BATCH_ROWS = 60_000


def log_normal(residual, spread):
    return -0.5 * (residual / spread) ** 2 - np.log(spread) - 0.5 * np.log(2 * np.pi)


def lone(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far x lies beyond both neighbours on one side, with its sign; 0 if it lies between them, nan if one is missing."""
    up, down = x - before, x - after
    return np.where(np.isnan(up + down), np.nan, np.where(np.sign(up) == np.sign(down), np.sign(up) * np.minimum(np.abs(up), np.abs(down)), 0.0))


def deviations(x: dict, before: dict, after: dict) -> np.ndarray:
    """(places, fields): how far each field is beyond its neighbours on its own. x has open, close, high and volume (logs), after has open as well.

    A close at which the next bar opens is a real price, so it deviates no more than it differs from that open. A high
    deviates only by what it rises above its own bar's open and close. Unknown opens leave the deviation as it is.
    """
    close, high, volume = (lone(x[c], before[c], after[c]) for c in FIELDS)
    gap = np.abs(x["close"] - after["open"])
    close = np.where(np.isnan(gap), close, np.sign(close) * np.minimum(np.abs(close), gap))
    body = np.fmax(x["open"], x["close"])
    high = np.where(np.isnan(body), high, np.minimum(np.maximum(high, 0.0), np.maximum(x["high"] - body, 0.0)))
    return np.column_stack([close, high, np.where(volume < 0, THIN * volume, volume)])


def neighbours(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last value before and the first after each place that isn't nan, within its group."""
    n = len(x)
    at = np.arange(n)
    has = ~np.isnan(x)

    def before(has_, group_, x_):
        last = np.maximum.accumulate(np.where(has_, at, -1))
        last = np.r_[-1, last[:-1]]
        ok = (last >= 0) & (group_[np.maximum(last, 0)] == group_)
        return np.where(ok, x_[np.maximum(last, 0)], np.nan)

    return before(has, group, x), before(has[::-1], group[::-1], x[::-1])[::-1]


def emissions(residuals: np.ndarray, spreads: np.ndarray, same: np.ndarray, broken: np.ndarray | None = None) -> np.ndarray:
    """Log density of each state for each place: residuals and spreads are (places, fields), nan residuals say nothing.

    A place that breaks hard bounds (broken; none if not given) is what the out-of-range state gives and hardly another: a state's density is
    that of the fields, even over the whole range when out of range, times the chance that it breaks bounds.
    """
    seen = ~np.isnan(residuals)
    known = np.where(seen, residuals, 0.0)
    plain = np.where(seen, log_normal(known, spreads), 0.0)
    for i, c in enumerate(FIELDS):
        if c in WIDE:
            weight, width = WIDE[c]
            wide = log_normal(known[:, i], width * spreads[:, i])
            plain[:, i] = np.where(seen[:, i], np.logaddexp(np.log1p(-weight) + plain[:, i], np.log(weight) + wide), 0.0)
    bad = np.where(seen, -np.log(BAD_RANGE), 0.0)
    either = np.where(seen, np.logaddexp(plain, bad) - np.log(2), 0.0)
    total = either.sum(axis=1, keepdims=True)
    spike = np.where(seen, np.log(1 / residuals.shape[1]) + bad + total - either, -np.inf)
    out = np.full((len(residuals), 4), -np.inf)
    out[:, NORMAL] = plain.sum(axis=1)
    with np.errstate(divide="ignore"):
        out[:, SPIKE] = np.where(seen.any(axis=1), np.logaddexp.reduce(spike, axis=1), -np.inf)
    out[:, STUCK] = plain.sum(axis=1)
    for state, p in SAME.items():
        out[:, state] += np.where(same, np.log(p), np.log1p(-p))
    out[:, OUT] = bad.sum(axis=1) + np.where(same, np.log(SAME[NORMAL]), 0.0)
    breaks = np.zeros(len(out), bool) if broken is None else broken
    for state, p in BREAKS.items():
        out[:, state] += np.where(breaks, np.log(p), np.log1p(-p))
    return out


def forward_backward(logs: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end in logs (days, states): what the days before and the days after say of each state, and
    the expected number of moves between states. moves is (series, states, states).

    All sequences take a step together, the longest first in order, so those that have ended drop off the end; memory goes
    with the days and not with the longest sequence.
    """
    n, k = logs.shape
    s = len(lengths)
    top = logs.max(axis=1, keepdims=True)
    dense = np.exp(logs - np.where(np.isfinite(top), top, 0.0))
    ahead, behind = np.ones((n, k)), np.ones((n, k))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    going = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    step, counts = moves[order], np.zeros((s, k, k))
    ahead[starts] = START
    for i in range(1, len(going)):
        m = going[i]
        at = starts[:m] + i
        mass = ahead[at - 1] * dense[at - 1]
        mass /= mass.sum(axis=1, keepdims=True) + 1e-300
        ahead[at] = np.einsum("sa,sab->sb", mass, step[:m])
    for i in range(len(going) - 2, -1, -1):
        m = going[i + 1]
        at = starts[:m] + i
        weight = dense[at + 1] * behind[at + 1]
        pulled = np.einsum("sab,sb->sa", step[:m], weight)
        behind[at] = pulled / (pulled.sum(axis=1, keepdims=True) + 1e-300)
        joint = (ahead[at] * dense[at])[:, :, None] * step[:m] * weight[:, None, :]
        counts[:m] += joint / (joint.sum(axis=(1, 2), keepdims=True) + 1e-300)
    out = np.empty_like(counts)
    out[order] = counts
    return ahead, behind, out


def spread_of(x: np.ndarray, group: np.ndarray, prior: float) -> np.ndarray:
    """Per group the robust spread of the day-to-day changes of x, pulled to prior when there are few."""
    before, _ = neighbours(x, group)
    change = np.abs(x - before)
    frame = pd.DataFrame({"g": group, "c": change})
    middle = frame.groupby("g")["c"].median().to_numpy() * 1.4826
    n = frame.groupby("g")["c"].count().to_numpy()
    middle = np.where(np.isnan(middle), prior, middle)
    return np.maximum(np.sqrt((n * middle**2 + PRIOR_BARS * prior**2) / (n + PRIOR_BARS)), 1e-4)


def run_lengths(keys: pd.Series, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys holds each day's bars (arrays of ints), place numbers the bar days of a group. For each bar of each day: the day's
    position, the bar, and the length of the run of successive bar days of the group that hold it."""
    at = np.repeat(np.arange(len(keys)), keys.map(len).to_numpy(int))
    key = np.concatenate([np.zeros(0, np.int64), *[np.asarray(k, np.int64) for k in keys if len(k)]])
    order = np.lexsort((place[at], key, group[at]))
    g, k, p = group[at][order], key[order], place[at][order]
    new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)][: len(at)]
    run = np.cumsum(new) - 1
    length = np.zeros(len(at), np.int64)
    length[order] = np.bincount(run)[run] if len(run) else 0
    return at, key, length


def day_contexts(f: pd.DataFrame) -> pd.DataFrame:
    """What the other days of its source say of each (source, day): f is sorted by them and holds whole sources.

    Columns in: source, day, close, high, volume, open (logs of the day's newest plausible reading, nan for none), keys
    (the day's bars that are delivered on other days as well), mounting (passed on), all_bad (no plausible row).
    """
    group = f.groupby("source", sort=False).ngroup().to_numpy()
    n = len(f)
    values = {c: f[c].to_numpy(float) for c in (*FIELDS, "open")}
    next_open = neighbours(values["open"], group)[1]
    spreads = np.column_stack([spread_of(values[c], group, PRIOR_SPREAD[c])[group] for c in FIELDS])
    linked = np.r_[False, group[1:] == group[:-1]]
    starts = np.flatnonzero(~linked)
    lengths = np.diff(np.r_[starts, n])
    place = np.arange(n) - starts[group]
    at, key, length = run_lengths(f["keys"], group, place)
    at, key, length = at[length > 1], key[length > 1], length[length > 1]
    same = np.zeros(n, bool)
    same[at] = True
    moves = np.broadcast_to(MOVES, (len(starts), 4, 4)).copy()
    broken = f["all_bad"].to_numpy(bool)
    clean = {c: v.copy() for c, v in values.items()}
    done = np.zeros(len(starts), bool)
    for _ in range(LEARN_ROUNDS):
        near = {c: neighbours(clean[c], group) for c in FIELDS}
        residuals = deviations(values, {c: near[c][0] for c in FIELDS}, {c: near[c][1] for c in FIELDS} | {"open": next_open})
        logs = emissions(residuals, spreads, same, broken)
        prior, after, counts = forward_backward(logs, lengths, moves)
        with np.errstate(divide="ignore"):
            weight = np.log(prior) + np.log(after)
        posterior = weight + logs
        posterior = np.exp(posterior - np.logaddexp.reduce(posterior, axis=1, keepdims=True))
        bad = posterior[:, SPIKE] > 0.5
        before = clean
        # Only the field that is off stops being a neighbour; the rest of the bar still counts.
        clean = {c: np.where(bad & (np.abs(residuals[:, i]) > 4 * spreads[:, i]), np.nan, values[c]) for i, c in enumerate(FIELDS)} | {"open": values["open"]}
        total = PRIOR_DAYS * np.array([1.0, 0.01, 0.01, 0.01])[:, None] * MOVES + counts
        learned = total / total.sum(axis=2, keepdims=True)
        # Each source ends by itself, so it doesn't matter which others share its batch.
        shifted = np.abs(learned - moves).max(axis=(1, 2), initial=0.0) >= LEARNED
        for c in FIELDS:
            shifted |= np.bincount(group, np.isnan(before[c]) != np.isnan(clean[c]), len(starts)) > 0
        done |= ~shifted
        if done.all():
            clean = before
            break
        moves = np.where(done[:, None, None], moves, learned)
        clean = {c: np.where(done[group], before[c], clean[c]) for c in clean}
    near = {c: neighbours(clean[c], group) for c in FIELDS}
    top = weight[:, :OUT].max(axis=1)
    out = {"source": f["source"], "day": f["day"], "volume_newest": values["volume"], "mounting": f["mounting"]}
    for s, name in enumerate(("normal", "spike", "stuck", "out")):
        out[f"w_{name}"] = np.exp(weight[:, s] - top)
    for i, c in enumerate(FIELDS):
        out[f"before_{c}"], out[f"after_{c}"], out[f"spread_{c}"] = near[c][0], near[c][1], spreads[:, i]
    out["after_open"] = next_open
    ends = np.cumsum(np.bincount(at, minlength=n))[:-1]
    out["run_keys"], out["run_days"] = np.split(key, ends), np.split(length, ends)
    return pd.DataFrame(out)


CONTEXT = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("day", T.IntegerType()), T.StructField("volume_newest", T.DoubleType()), T.StructField("mounting", T.BooleanType())]
    + [T.StructField(f"w_{s}", T.DoubleType()) for s in ("normal", "spike", "stuck", "out")]
    + [T.StructField(f"{p}_{c}", T.DoubleType()) for c in FIELDS for p in ("before", "after", "spread")]
    + [T.StructField("after_open", T.DoubleType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("run_keys", "run_days")]
)


def impossible() -> Column:
    """Hard bounds on a bar: a price not above zero, a volume below zero, a high below low, open or close. Nulls break none."""
    low = lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))
    under = lambda c: F.coalesce(F.col("high") < F.col(c), F.lit(False))
    return low("open") | low("high") | low("low") | low("close") | F.coalesce(F.col("volume") < 0, F.lit(False)) | under("low") | under("open") | under("close")


def _mounting() -> Column:
    """Whether a day's plausible volumes (as an aggregate) rise on balance with their time of delivery and over several steps.

    The sum of (v - least)(most - v) over the logs is 0 where there are but two values, as for a low volume and its repair.
    """
    v = F.when(~F.col("is_impossible") & (F.col("volume") > 0), F.log("volume"))
    low, high = F.min(v), F.max(v)
    between = (low + high) * F.sum(v) - F.sum(v * v) - F.count(v) * low * high
    time = F.col("ing").cast("timestamp").cast("double") - F.col("day") * F.lit(86_400.0)
    rising = F.covar_pop(F.when(v.isNotNull(), time), v) > 0
    return F.coalesce(rising & (high > low) & (between >= BETWEEN * (high - low) * (high - low)), F.lit(False))


def flag_bars(bars: DataFrame, *, row_id: str, source: str, at: str, ingested: str, longest_live_run: int = 5) -> DataFrame:
    """Every row of bars with its posterior and flags: row_id, p_spike, p_stuck, is_spike, is_stuck, is_impossible, flagged.

    bars has open, high, low, close, volume; nan counts as null. Each (source, day) is first reduced to a fixed-size
    summary (newest plausible close, high and volume) and those of its bars that other days repeat, so a source is as long as its calendar,
    however often its bars are delivered. Per source a hidden Markov model over days with states normal, spike, stuck
    and out of range gives, by forward-backward, what the other days say of each day; every delivered row is then
    judged by its own values under that: lone deviation from the neighbouring bars against the source's own spread, equality with
    neighbouring days, hard bounds. A posterior over a half decides; a stuck bar must also stand for more than
    longest_live_run successive bar days. A volume below the newest plausible one of a day isn't low if the day's volumes mount from pull to pull.

    Nulls are never flagged. A field whose previous or next reading doesn't exist says nothing of spikes. Repeated rows
    get the same flags. Rows with a null source or at have only hard bounds. Empty input gives no rows.
    """
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = bars.select(
        F.col(row_id).cast("long").alias("row"), F.col(source).alias("source"), day_number(at).alias("day"), F.col(ingested).alias("ing"),
        *[num(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    key = F.when(whole, F.xxhash64("open", "high", "low", "close")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("key", key).withColumn("is_impossible", impossible())
    order = F.struct(F.col("ing"), F.col("row"))
    log = lambda c: F.when(F.col(c) > 0, F.log(F.col(c))).when(F.col(c) == 0, F.lit(0.0))
    fine = lambda c: F.when(~F.col("is_impossible") & F.col(c).isNotNull(), F.struct(order.alias("o"), log(c).alias("v")))
    daily = (
        rows.where("source is not null and day is not null")
        .groupBy("source", "day")
        .agg(
            *[F.max(fine(c)).getField("v").alias(c) for c in (*FIELDS, "open")],
            _mounting().alias("mounting"),
            F.min(F.col("is_impossible")).alias("all_bad"),
        )
    )

    # Only bars that some other day of the source holds as well can be in a run; few are, and they go by source and bar.
    dated = rows.where("source is not null and day is not null and key <> 0")
    repeated = dated.groupBy("source", "key").agg(F.collect_set("day").alias("days")).where(F.size("days") > 1)
    repeated = repeated.select("source", F.explode("days").alias("day"), "key").groupBy("source", "day").agg(F.collect_list("key").alias("keys"))
    daily = daily.join(repeated, ["source", "day"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["source"], BATCH_ROWS):
            yield day_contexts(f)

    series = daily.select("source", "day", *FIELDS, "open", "keys", "mounting", "all_bad")
    contexts = spread(series, "source").sortWithinPartitions("source", "day").mapInPandas(learn, CONTEXT)
    joined = join_spread(rows.drop("ing"), contexts, on=["source", "day"], key="source", spread="row", how="left")
    return _judge(joined, longest_live_run).select(F.col("row").alias(row_id), "p_spike", "p_stuck", "is_spike", "is_stuck", "is_impossible", "flagged")


PAIR = T.StructType([T.StructField("p_spike", T.DoubleType()), T.StructField("p_stuck", T.DoubleType())])


@F.pandas_udf(PAIR)
def posterior(
    close: pd.Series, high: pd.Series, volume: pd.Series, open_: pd.Series, before_close: pd.Series, before_high: pd.Series, before_volume: pd.Series,
    after_close: pd.Series, after_high: pd.Series, after_volume: pd.Series, after_open: pd.Series, spread_close: pd.Series, spread_high: pd.Series, spread_volume: pd.Series,
    w_normal: pd.Series, w_spike: pd.Series, w_stuck: pd.Series, run: pd.Series, mounting: pd.Series,
) -> pd.DataFrame:
    """A row's posterior from its own values (logs) and what the other days say; nan where its day has no context."""
    named = lambda *columns: {c: x.to_numpy(float) for c, x in zip((*FIELDS, "open"), columns)}
    residuals = deviations(named(close, high, volume, open_), named(before_close, before_high, before_volume), named(after_close, after_high, after_volume, after_open))
    below = mounting.to_numpy(bool) & (residuals[:, 2] < 0)
    residuals[below, 2] = 0.0
    spreads = np.column_stack([x.to_numpy(float) for x in (spread_close, spread_high, spread_volume)])
    logs = emissions(residuals, np.where(np.isnan(spreads), 1.0, spreads), run.to_numpy(float) > 1)[:, :OUT]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = logs + np.log(np.column_stack([w.to_numpy(float) for w in (w_normal, w_spike, w_stuck)]))
        shares = np.exp(logs - np.logaddexp.reduce(logs, axis=1, keepdims=True))
    return pd.DataFrame({"p_spike": shares[:, SPIKE], "p_stuck": shares[:, STUCK]})


def _judge(joined: DataFrame, longest_live_run: int) -> DataFrame:
    log = lambda c: F.when(F.col(c) > 0, F.log(F.col(c))).when(F.col(c) == 0, F.lit(0.0))
    run = F.map_from_arrays("run_keys", "run_days")[F.col("key")]
    mounting = F.coalesce(F.col("mounting") & (log("volume") < F.col("volume_newest")), F.lit(False))
    near = [F.col(f"{p}_{c}") for p, fields in (("before", FIELDS), ("after", (*FIELDS, "open")), ("spread", FIELDS)) for c in fields]
    judged = joined.withColumn("run", F.when(F.col("key") != 0, F.coalesce(run, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).withColumn(
        "p", posterior(*[log(c) for c in (*FIELDS, "open")], *near, "w_normal", "w_spike", "w_stuck", "run", mounting)
    )
    share = lambda c: F.when(F.col("is_impossible") | F.col(c).isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.col(c))
    return (
        judged.withColumn("p_spike", share("p.p_spike"))
        .withColumn("p_stuck", share("p.p_stuck"))
        .withColumn("is_spike", F.col("p_spike") > 0.5)
        .withColumn("is_stuck", (F.col("p_stuck") > 0.5) & (F.col("run") > longest_live_run))
        .withColumn("flagged", F.col("is_spike") | F.col("is_stuck") | F.col("is_impossible"))
    )
