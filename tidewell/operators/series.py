"""Window expressions for series; a window counts only when it is full, as the reference semantics of rolling features ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def rolling(expression: Column, over: WindowSpec, n: int, counted: Column | str, least: int | None = None) -> Column:
    """expression over the last n rows, null unless counted isn't null in at least least (default n) of them."""
    w = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(counted).over(w) >= (n if least is None else least), expression.over(w))


def correlation(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows that have both, as an aggregate or over a window; null where either doesn't vary.

    The built-in aggregate fails on a series without variance under ANSI rules.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    made = lambda e: e if over is None else e.over(over)
    return F.try_divide(made(F.covar_pop(a, b)), made(F.stddev_pop(a)) * made(F.stddev_pop(b)))


def rolling_correlation(x: str, y: str, over: WindowSpec, n: int) -> Column:
    """correlation over the last n rows, null unless there are n."""
    w = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) >= n, correlation(x, y, w))


def log_return(c: Column | str, over: WindowSpec, k: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    ratio = F.try_divide(c, F.lag(c, k).over(over))
    return F.when(ratio > 0, F.ln(ratio))


def simple_return(c: Column | str, over: WindowSpec, k: int = 1) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(c, F.lag(c, k).over(over)) - 1


def percent_rank_average(c: str, by: list[str]) -> Column:
    """Share of ranks with ties averaged, in (0, 1]; null values stay null and aren't counted."""
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(F.col(c).isNotNull(), (below + (ties - 1) / F.lit(2.0)) / F.count(c).over(Window.partitionBy(*by)))


def z_score(c: str, by: list[str]) -> Column:
    """Cross-sectional z with the sample deviation; 0 where there is no deviation."""
    w = Window.partitionBy(*by)
    spread = F.stddev_samp(c).over(w)
    return F.when(F.col(c).isNotNull(), F.when(spread > 0, (F.col(c) - F.avg(c).over(w)) / spread).otherwise(F.lit(0.0)))


def winsorize(df: DataFrame, columns: list[str], by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """columns clipped to the exact quantiles of their group; nulls stay null."""
    bounds = df.groupBy(*by).agg(*[F.percentile(c, q).alias(f"_{s}_{c}") for c in columns for s, q in (("l", low), ("h", high))])
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_h_{c}")), F.col(f"_l_{c}"))) for c in columns}
    return df.join(bounds, by, "left").select(*[clipped.get(c, F.col(c)).alias(c) for c in df.columns])


def drawdowns(df: DataFrame, *, by: list[str], order: str, ret: str) -> DataFrame:
    """Adds equity (growth of 1), peak, drawdown and episode (number of the stretch since the last peak)."""
    w = Window.partitionBy(*by).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    grown = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.coalesce(F.col(ret), F.lit(0.0)))).over(so_far)))
    peaked = grown.withColumn("peak", F.greatest(F.max("equity").over(so_far), F.lit(1.0)))
    down = peaked.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    at_peak = F.when(F.col("drawdown") > -1e-12, 1).otherwise(0)
    return down.withColumn("episode", F.sum(at_peak).over(so_far))
