"""Filling containers of fixed capacity: a configuration linear program over the histogram of lengths.

Everything that decides how packs are made works on the histogram, which has at most as many rows as the capacity,
whatever the number of documents; one task per capacity solves its program. Documents then find their pack by their
rank among those of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut

#: Share of what a configuration could still take of its scarcest length that one step takes.
STEP = 0.5
#: How fast a length's weight falls as it is covered, one pass over the program each.
FALLS = (0.3, 0.1, 0.03, 0.2, 0.05, 0.0, 0.15, 0.01)
#: Packs that lie above the bound by no more than this share are good enough, as are packs of which no whole one can be saved.
GAP = 0.0005
#: Where passes end with a larger gap than this, the weights are learned further, so many rounds before each new pass.
WIDE_GAP, ROUNDS = 0.005, 400
#: How much more a token of a long item counts than one of a short item at the start: long items are harder to place.
LONG = 0.05
#: Lengths that one step prices: those of the greatest weight, and the shortest.
HEAVY, SHORT = 96, 32
#: Rows of one length that one task ranks.
RANKED_ROWS = 50_000


@dataclass
class Plan:
    """Runs of slots: many packs from pack on hold each items of a length; the first of these has the rank first."""

    length: np.ndarray
    first: np.ndarray
    pack: np.ndarray
    each: np.ndarray
    packs: int
    bound: float

    @property
    def gap(self) -> float:
        """How far the packs lie above the bound of the linear program, as a share of it."""
        return self.packs / self.bound - 1 if self.bound else 0.0


def best_configuration(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length that fit the capacity at the greatest total price: a bounded knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for g in np.argsort(-sizes, kind="stable"):
        left, copies = min(int(most[g]), capacity // int(sizes[g])), 1
        while left > 0:
            k = min(copies, left)
            weight = k * int(sizes[g])
            offered = value[: capacity + 1 - weight] + k * prices[g]
            better = offered > value[weight:] + 1e-12
            value[weight:] = np.where(better, offered, value[weight:])
            taken.append((int(g), k, better))
            left -= k
            copies *= 2
    out = np.zeros(len(sizes), np.int64)
    room = capacity
    for g, k, better in reversed(taken):
        weight = k * int(sizes[g])
        if room >= weight and better[room - weight]:
            out[g] += k
            room -= weight
    return out


def cover(counts: np.ndarray, capacity: int, weights: np.ndarray, fall: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """One pass: configurations (lengths, copies of each) and how many packs of each, which together hold every item once.

    counts and weights are by length. A length's weight falls exponentially with the share of it that is covered, and to nothing
    once all of it is. Each step prices configurations by the weights of the lengths that weigh most (per token) and of the
    shortest, takes the best and adds a whole number of packs of it: at least one, at most as many as cover STEP of what
    is left of one of its lengths. So the solution is rounded as it is made, and each step ends one length or a STEP of it.
    """
    left = counts.copy()
    steps = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return steps
        density = weights[lengths] / lengths * np.exp(-fall * (1 - left[lengths] / counts[lengths]))
        if len(lengths) > HEAVY + SHORT:
            heavy = np.argpartition(-density, HEAVY)[:HEAVY]
            picked = np.union1d(heavy, np.arange(SHORT))
            lengths, density = lengths[picked], density[picked]
        copies = best_configuration(lengths, density * lengths, left[lengths], capacity)
        used = copies > 0
        many = max(1, int(STEP * (left[lengths[used]] / copies[used]).min()))
        left[lengths] -= copies * many
        steps.append((lengths[used], copies[used], many))


def learn(counts: np.ndarray, capacity: int, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Better weights by length, and the bound they give, after rounds of multiplicative weights with falling steps.

    Each round prices all lengths, takes the best configuration and lowers the weights of the lengths it covers, in
    proportion to the share of them that it covers. The weights that gave the best bound are returned.
    """
    lengths = np.flatnonzero(counts)
    w, n = weights[lengths].copy(), counts[lengths]
    best, bound = w.copy(), 0.0
    for t in range(rounds):
        a = best_configuration(lengths, w / w.max(), n, capacity)
        offered = float(w @ n) / float(w @ a)
        if offered > bound:
            best, bound = w.copy(), offered
        share = a / n
        w = w * np.exp(-0.1 / (1 + t) ** 0.5 * share / share.max())
    out = weights.copy()
    out[lengths] = best / best.max()
    return out, bound


def solve(counts: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """Configurations with their packs, and a lower bound on the packs needed, for counts of the lengths 1 to capacity.

    The bound is the value of a dual solution: any weights divided by the best price of a configuration, found by the
    knapsack over all lengths. Each pass starts from weights that were raised, by a factor, for lengths whose packs stayed
    unfilled in the pass before, and, where that leaves a wide gap, from learned ones. The best pass is kept. It ends when
    the gap is closed or after the last of FALLS.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return [], 0.0
    every = np.arange(capacity + 1)
    weights = every / capacity * (1 + LONG * every / capacity)
    bound = float((every * counts).sum()) / capacity
    best: list | None = None
    least = 0
    for fall in FALLS:
        steps = cover(counts, capacity, weights, fall)
        packs = sum(s[2] for s in steps)
        if best is None or packs < least:
            best, least = steps, packs
        price = weights[lengths]
        top = best_configuration(lengths, price / price.max(), counts[lengths], capacity)
        bound = max(bound, float(price @ counts[lengths]) / float(price @ top))
        if least <= max(np.ceil(bound - 1e-6), bound * (1 + GAP)):
            break
        room = np.zeros(capacity + 1)
        for sizes, copies, many in steps:
            room[sizes] += copies * many * (capacity / float(sizes @ copies))
        weights[lengths] *= room[lengths] / counts[lengths]
        if least > bound * (1 + WIDE_GAP) + 1:
            weights, learned = learn(counts, capacity, weights)
            bound = max(bound, learned)
    return best or [], bound


def plan_packs(histogram: np.ndarray, capacity: int) -> Plan:
    """A pack for every item: histogram[l] is the number of items of l tokens, 1 <= l <= capacity. All packs come from configurations."""
    counts = histogram.astype(np.int64).copy()
    counts[0] = 0
    steps, bound = solve(counts, capacity)
    given = np.zeros(capacity + 1, np.int64)
    slots: list[np.ndarray] = []
    packs = 0
    for lengths, copies, many in steps:
        slots.append(np.column_stack([lengths, given[lengths], np.full(len(lengths), packs), copies]))
        given[lengths] += copies * many
        packs += many
    table = np.concatenate(slots) if slots else np.zeros((0, 4), np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], packs, bound)


def _pieces(tokens: DataFrame, capacities: dict[str, int], row_id: str, n_tokens: str) -> DataFrame:
    size = F.greatest(F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)), F.lit(0))
    options = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in sorted(capacities.items())])
    return tokens.select(F.col(row_id), size.alias("_size"), F.explode(options).alias("_o")).select(row_id, "_size", "_o.*")


def make_plans(tokens: DataFrame, capacities: dict[str, int], *, row_id: str, n_tokens: str = "n_tokens") -> tuple[dict[str, Plan], int]:
    """The plan of each capacity and the greatest number of items of one length. Each program is solved in a task of its own.

    What comes to the driver are the plans' runs: about log2(items of a length) configurations for each
    length up to the capacity, however many documents there are.
    """
    if not capacities:
        return {}, 0
    if min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    each = _pieces(tokens, capacities, row_id, n_tokens)

    def program(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held)
        capacity = int(f["capacity"].iloc[0])
        counts = np.zeros(capacity + 1, np.int64)
        counts[f["length"].to_numpy(np.int64)] = f["items"].to_numpy(np.int64)
        p = plan_packs(counts, capacity)
        out = pd.DataFrame({"length": p.length, "first": p.first, "pack": p.pack, "each": p.each})
        yield out.assign(pack_name=f["pack_name"].iloc[0], packs=p.packs, bound=p.bound, most=counts.max())

    schema = "length long, first long, pack long, each long, pack_name string, packs long, bound double, most long"
    counted = cut(histogram(each))
    # Different numbers of partitions, or the union would put the programs into one task.
    solved = [counted.where(F.col("pack_name") == n).repartition(i + 1, "pack_name").mapInPandas(program, schema) for i, n in enumerate(sorted(capacities))]
    runs = reduce(DataFrame.unionByName, solved).toPandas()
    plans = {}
    for name, f in runs.groupby("pack_name", sort=True):
        columns = [f[c].to_numpy(np.int64) for c in ("length", "first", "pack", "each")]
        plans[name] = Plan(*columns, int(f["packs"].iloc[0]), float(f["bound"].iloc[0]))
    return plans, int(runs["most"].max()) if len(runs) else 0


def pack(tokens: DataFrame, capacities: dict[str, int], *, row_id: str, n_tokens: str = "n_tokens", planned: tuple[dict[str, Plan], int] | None = None) -> DataFrame:
    """Every document in packs of each capacity: pack_name, pack_no (from 1), row_id, piece_no (from 1), tokens_used.

    A document of more tokens than the capacity is cut into full packs and a rest; no other is cut. A document of no
    tokens takes no room and is listed in pack 1. Rows that repeat a row_id are items of their own. Null row_ids and
    null or negative sizes count as no tokens. Capacities must be positive; none, or no documents, give no rows.

    Items of one length are ranked in buckets small enough for a task, with the buckets' sizes summed up between, so a
    length that many items share is no single task. planned takes what make_plans returned for the same arguments.
    """
    if not capacities:
        return tokens.select(row_id).limit(0).selectExpr("'' as pack_name", "0L as pack_no", row_id, "0 as piece_no", "0L as tokens_used")
    plans, most = planned or make_plans(tokens, capacities, row_id=row_id, n_tokens=n_tokens)
    each = _pieces(tokens, capacities, row_id, n_tokens)
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("_size") / F.col("capacity")), F.lit(1)).cast("int"))))
    used = F.least(F.col("capacity"), F.col("_size") - (F.col("piece_no") - 1) * F.col("capacity"))
    items = pieces.withColumn("tokens_used", used).drop("_size", "capacity")
    buckets = -(-most // RANKED_ROWS) or 1
    items = items.withColumn("_bucket", F.pmod(F.xxhash64(row_id, "piece_no"), F.lit(buckets)).cast("int"))
    keys = ["pack_name", "tokens_used"]
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(row_id, "piece_no")) - 1
    ranked = items.withColumn("_local", local)
    if buckets > 1:
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = items.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        ranked = ranked.join(sums.drop("_n"), [*keys, "_bucket"])
    else:
        ranked = ranked.withColumn("_before", F.lit(0).cast("long"))
    table = {n: (p.length * (1 << 40) + p.first, p.first, p.pack, p.each) for n, p in plans.items()}

    @F.pandas_udf("long")
    def pack_no(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, length, rank in batches:
            out = np.ones(len(name), np.int64)
            l, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)  # noqa: E741
            for n in name.unique():
                if n not in table:
                    continue
                keyed, first, start, each_ = table[n]
                mine = (name == n).to_numpy() & (l > 0)
                at = np.searchsorted(keyed, l[mine] * (1 << 40) + r[mine], "right") - 1
                out[mine] = start[at] + (r[mine] - first[at]) // each_[at] + 1
            yield pd.Series(out)

    rank = F.col("_before") + F.col("_local")
    return ranked.select("pack_name", pack_no("pack_name", "tokens_used", rank).alias("pack_no"), F.col(row_id), F.col("piece_no").cast("int").alias("piece_no"), "tokens_used")


def histogram(each: DataFrame) -> DataFrame:
    """Rows (pack_name, capacity, length, items): at most the sum of the capacities. Full packs of cut documents count as items of the capacity."""
    rest = F.when(F.col("_size") <= F.col("capacity"), F.col("_size")).otherwise(F.col("_size") % F.col("capacity"))
    full = F.when(F.col("_size") > F.col("capacity"), F.floor(F.col("_size") / F.col("capacity"))).otherwise(F.lit(0).cast("long"))
    parts = F.array(F.struct(rest.alias("length"), F.when(rest > 0, 1).otherwise(0).cast("long").alias("items")), F.struct(F.col("capacity").alias("length"), full.alias("items")))
    exploded = each.select("pack_name", "capacity", F.explode(parts).alias("p")).where("p.items > 0")
    return exploded.groupBy("pack_name", "capacity", F.col("p.length").alias("length")).agg(F.sum("p.items").alias("items"))
