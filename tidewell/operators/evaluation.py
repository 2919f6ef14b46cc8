"""Performance of return series, least squares from sums, bootstrap intervals and position folds."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.series import drawdowns

YEAR = 252


def performance(df: DataFrame, *, by: list[str], order: str, ret: str) -> DataFrame:
    """One row per series, with its longest stretch under water, return a year and that over its deepest drawdown. A series without spread has a Sharpe ratio of 0; one without losses has null Sortino and profit factor."""
    down = F.sqrt(F.sum(F.pow(F.least(F.col(ret), F.lit(0.0)), F.lit(2.0))) / F.count(ret))
    spread = F.stddev_samp(ret)
    fell = drawdowns(df, by=by, order=order, ret=ret)
    days = F.count_if(F.col("drawdown") <= -1e-12).over(Window.partitionBy(*by, "episode"))
    a_year = F.exp(F.sum(F.ln(1 + F.col(ret))) * YEAR / F.count(ret)) - 1
    return fell.withColumn("_under", days).groupBy(*by).agg(
        F.count(ret).alias("n"), F.max("_under").alias("underwater_days"), F.round(a_year, 6).alias("annual_return"), F.round(F.try_divide(a_year, F.abs(F.min("drawdown"))), 5).alias("calmar"), F.round(F.when(spread > 1e-15, F.try_divide(F.avg(ret), spread) * math.sqrt(YEAR)).otherwise(F.lit(0.0)), 6).alias("sharpe"),
        F.round(F.try_divide(F.avg(ret), down) * math.sqrt(YEAR), 6).alias("sortino"), F.round(F.min("drawdown"), 8).alias("max_drawdown"), F.round(F.exp(F.sum(F.ln(1 + F.col(ret)))) - 1, 8).alias("total_return"),
        F.round(F.count_if(F.col(ret) > 0) / F.count(ret), 8).alias("win_rate"), F.round(F.try_divide(F.sum(F.greatest(F.col(ret), F.lit(0.0))), -F.sum(F.least(F.col(ret), F.lit(0.0)))), 6).alias("profit_factor"),
    )


def least_squares(df: DataFrame, *, by: list[str], y: str, xs: list[str], ridge: float = 0.0) -> DataFrame:
    """Per group intercept and slopes of y on xs, their t-values, r2 and n; null where the system is singular or n is too small.

    ridge is added to the sums of squares of the slopes, not to the intercept's; t-values are then only indicative.
    Only sums of products are shuffled: (k + 2) squared numbers per group, whatever its rows.
    """
    terms = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    k = len(xs) + 1
    sums = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    moments = df.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    names = ["intercept", *xs]
    fields = ", ".join(f"beta_{n} double, t_{n} double" for n in names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*by, "n").schema) + f", {fields}, r2 double"

    def solve(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
                a, b, yy, n = m[:k, :k] + ridge * np.diag([0.0] + [1.0] * (k - 1)), m[:k, k], m[k, k], int(r["n"])
                out = {c: r[c] for c in [*by, "n"]}
                if n > k and np.linalg.matrix_rank(a) == k:
                    inverse = np.linalg.inv(a)
                    beta = inverse @ b
                    rest = max(yy - 2 * beta @ b + beta @ m[:k, :k] @ beta, 0.0)
                    total = yy - m[0, k] ** 2 / n
                    errors = np.sqrt(np.maximum(np.diag(inverse) * rest / (n - k), 0.0))
                    for i, c in enumerate(names):
                        out[f"beta_{c}"] = float(beta[i])
                        out[f"t_{c}"] = float(beta[i] / errors[i]) if errors[i] > 0 else None
                    out["r2"] = float(1 - rest / total) if total > 0 else None
                rows.append(out)
            yield pd.DataFrame(rows, columns=[*by, "n", *[f"{p}_{c}" for c in names for p in ("beta", "t")], "r2"])

    return moments.mapInPandas(solve, schema)


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float | None:
    """Probability that the true per-period Sharpe ratio is above benchmark; kurt is raw (3 for a normal). None where it has no error."""
    if n < 2:
        return None
    variance = (1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2) / (n - 1)
    return NormalDist().cdf((sharpe - benchmark) / math.sqrt(variance)) if variance > 0 else None


def expected_best_sharpe(trials: int, spread: float) -> float:
    """The Sharpe ratio that the best of so many unskilled trials is expected to show."""
    if trials < 2 or spread <= 0:
        return 0.0
    euler, normal = 0.5772156649015329, NormalDist()
    return spread * ((1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e)))


def deflate(trials: pd.DataFrame) -> pd.DataFrame:
    """trials (sharpe a year, skew, kurtosis raw, n) with benchmark_sharpe, what the best of them is expected to show by chance, and dsr, the
    probability that a trial's true ratio is above it."""
    benchmark = expected_best_sharpe(len(trials), float(trials["sharpe"].std(ddof=0)) if len(trials) else 0.0)
    year = math.sqrt(YEAR)
    told = [probabilistic_sharpe(r.sharpe / year, int(r.n), r.skew, r.kurtosis, benchmark / year) for r in trials.itertuples()]
    dsr = [0.0 if p is None else p for p in told]
    return trials.assign(benchmark_sharpe=benchmark, dsr=dsr, is_significant=[p > 0.95 for p in dsr])


def walk_forward(bars: int, folds: int, *, test: int, purge: int, anchored: bool = True, train: int | None = None) -> list[tuple[range, range]]:
    """Train and test ranges of each fold, the last test ending with the last bar; purge bars lie between them."""
    out = []
    for k in range(folds):
        start = bars - (folds - k) * test
        end = start - purge
        begin = 0 if anchored else end - (train or test)
        if begin < 0 or end <= begin:
            raise ValueError(f"fold {k} has no bars to train on")
        out.append((range(begin, end), range(start, start + test)))
    return out


def backtest_overfitting(returns: np.ndarray, parts: int = 8) -> float:
    """Share of combinatorial splits in which the configuration best in sample ranks in the lower half out of sample. returns is (days, configurations);
    scores are equal if they are to nine places."""
    from itertools import combinations

    blocks = np.array_split(np.arange(len(returns)), parts)
    worse = total = 0
    for chosen in combinations(range(parts), parts // 2):
        inside = np.concatenate([blocks[i] for i in chosen])
        outside = np.setdiff1d(np.arange(len(returns)), inside)
        score = lambda rows: np.round(returns[rows].mean(axis=0) / (returns[rows].std(axis=0, ddof=1) + 1e-15), 9)
        best, out = int(np.argmax(score(inside))), score(outside)
        rank = (out < out[best]).sum() + 0.5 * ((out == out[best]).sum() - 1)
        worse += rank / max(len(out) - 1, 1) < 0.5
        total += 1
    return worse / total


def augmented_dickey_fuller(x: np.ndarray, lags: int = 1) -> float | None:
    """The t-value of the level in a regression of changes on level, constant and lagged changes; None if the series is too short or flat."""
    x = np.asarray(x, float)
    d = np.diff(x)
    if len(d) <= 2 * lags + 3 or d.std() == 0:
        return None
    y = d[lags:]
    a = np.column_stack([np.ones(len(y)), x[lags:-1], *[d[lags - i : len(d) - i] for i in range(1, lags + 1)]])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ beta
    covariance = np.linalg.pinv(a.T @ a) * (rest @ rest) / (len(y) - a.shape[1])
    return float(beta[1] / math.sqrt(covariance[1, 1])) if covariance[1, 1] > 0 else None


def sharpe_intervals(df: DataFrame, *, by: str, order: str, ret: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """Per series Sharpe ratio, 90 percent bootstrap interval and probabilistic Sharpe ratio. A series has one row per day, so a group is as long as a calendar."""
    schema = f"{by} string, n long, sharpe double, low double, high double, psr double"

    def one(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values(order)[ret].to_numpy(float)
        n, sd = len(x), x.std(ddof=1) if len(x) > 1 else 0.0
        if n < 3 or sd < 1e-15:
            return pd.DataFrame({by: [f[by].iloc[0]], "n": [n], "sharpe": [0.0], "low": [None], "high": [None], "psr": [None]}).astype({"low": float, "high": float, "psr": float})
        rng = np.random.default_rng(seed)
        picks = x[rng.integers(0, n, size=(draws, n))]
        deviation = picks.std(axis=1, ddof=1)
        sharpes = np.where(deviation > 1e-15, picks.mean(axis=1) / np.maximum(deviation, 1e-15), 0.0) * math.sqrt(YEAR)
        z = (x - x.mean()) / x.std()
        psr = probabilistic_sharpe(x.mean() / sd, n, float((z**3).mean()), float((z**4).mean()))
        low, high = np.percentile(sharpes, [5, 95])
        return pd.DataFrame({by: [f[by].iloc[0]], "n": [n], "sharpe": [x.mean() / sd * math.sqrt(YEAR)], "low": [low], "high": [high], "psr": [psr]})

    return df.select(by, order, ret).groupBy(by).applyInPandas(one, schema)


def fold_positions(fills: DataFrame, *, by: list[str], order: str, quantity: str, price: str) -> DataFrame:
    """Per key the open quantity, average cost and realised gain after all fills in order.

    Fills on the side of the position move its average cost; others realise gains on what they close, and what is left
    over opens the other side at the fill's price. The order of fills matters, so a key's fills meet in one task; the
    fold itself runs over a sorted array inside the JVM.
    """
    one = F.struct(F.col(order).alias("o"), F.col(quantity).cast("double").alias("q"), F.col(price).cast("double").alias("p"))
    grouped = fills.where(F.col(quantity).isNotNull() & F.col(price).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("_f"), F.count("*").alias("fills"))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"), F.lit(0.0).alias("g"))

    def step(a, f):
        same = (a.q == 0) | (F.signum(a.q) == F.signum(f.q))
        closed = F.least(F.abs(a.q), F.abs(f.q)) * F.signum(a.q)
        q = a.q + f.q
        cost = F.when(same, F.try_divide(a.c * F.abs(a.q) + f.p * F.abs(f.q), F.abs(q))).when(q == 0, F.lit(0.0)).when(F.signum(q) == F.signum(a.q), a.c).otherwise(f.p)
        gain = F.when(same, a.g).otherwise(a.g + closed * (f.p - a.c))
        return F.struct(q.alias("q"), F.coalesce(cost, F.lit(0.0)).alias("c"), gain.alias("g"))

    done = grouped.withColumn("_s", F.aggregate("_f", start, step))
    return done.select(*by, "fills", F.round("_s.q", 6).alias("quantity"), F.round("_s.c", 8).alias("average_cost"), F.round("_s.g", 8).alias("realised"))
