"""Trials of configurations: folds, scores out of sample, and how far the best of many can be trusted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import evaluation as ev
from tidewell.operators.series import simple_return
from tidewell.plans.base import BENCHMARK, SOUND_SQL, Book, by_symbol, sound_bars
from tidewell.plans.statistics import _PF_SQL, portfolio

book = Book()
_W = "partition by symbol order by timestamp"
#: Lookbacks of momentum that are tried, and how many symbols a book holds.
LOOKBACKS, HELD = (5, 10, 21, 42, 63), 5
FOLDS, HORIZON, BUFFER = 4, 5, 5

_TRIALS_SQL = f"""b as ({SOUND_SQL}), f as (select symbol, timestamp, lead(close) over ({_W}) / close - 1 as fwd,
        {', '.join(f'close / lag(close, {k}) over ({_W}) - 1 as m{k}' for k in LOOKBACKS)} from b),
    l as ({' union all '.join(f'select {k} as config, symbol, timestamp, fwd, m{k} as mom from f' for k in LOOKBACKS)}),
    k as (select *, row_number() over (partition by config, timestamp order by mom desc,
        symbol) as n from l where mom is not null and fwd is not null and symbol <> '{BENCHMARK}'),
    t as (select config, timestamp, avg(fwd) as ret from k where n <= {HELD} group by all)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config, timestamp, ret: the next return of equal weights in the strongest symbols, for each lookback. The lookbacks are laid out by row, so they share one pass over the bars."""
    w = by_symbol()
    b = sound_bars(spark, sf_dir)
    moms = [F.struct(F.lit(k).alias("config"), simple_return("close", w, k).alias("mom")) for k in LOOKBACKS]
    made = b.select("symbol", "timestamp", (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"), F.array(*moms).alias("_all"))
    laid = made.select("symbol", "timestamp", "fwd", F.explode("_all").alias("e")).select("symbol", "timestamp", "fwd", "e.config", "e.mom")
    laid = laid.where(F.col("mom").isNotNull() & F.col("fwd").isNotNull() & (F.col("symbol") != BENCHMARK))
    n = F.row_number().over(Window.partitionBy("config", "timestamp").orderBy(F.desc("mom"), "symbol"))
    return laid.withColumn("n", n).where(F.col("n") <= HELD).groupBy("config", "timestamp").agg(F.avg("fwd").alias("ret"))


@book.query(f"""with {_TRIALS_SQL}, s as (select config, avg(ret) as m, stddev_pop(ret) as sp, stddev_samp(ret) as sd, count(*) as n from t group by config)
    select config, n, round(m / sd * sqrt(252), 6) as sharpe, round(avg(((ret - m) / sp) ** 3), 5) as skew, round(avg(((ret - m) / sp) ** 4),
        4) as kurtosis from t join s using (config) group by config, n, m, sd""")
def trial_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio, skewness and kurtosis of each configuration's returns."""
    t = trials(spark, sf_dir)
    s = t.groupBy("config").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sp"), F.stddev_samp("ret").alias("sd"), F.count("*").alias("n"))
    z = (F.col("ret") - F.col("m")) / F.col("sp")
    g = t.join(s, "config").groupBy("config", "n", "m", "sd").agg(F.round(F.avg(z * z * z), 5).alias("skew"), F.round(F.avg(z * z * z * z), 4).alias("kurtosis"))
    return g.select("config", "n", F.round(F.col("m") / F.col("sd") * F.sqrt(F.lit(252)), 6).alias("sharpe"), "skew", "kurtosis")


_BEST_OF = ev.expected_best_sharpe(len(LOOKBACKS), 1.0)


@book.query(f"""with {_TRIALS_SQL}, s as (select config, avg(ret) as m, stddev_pop(ret) as sp, stddev_samp(ret) as sd, count(*) as n from t group by config),
    mo as (select config, n, round(m / sd * sqrt(252), 6) as sharpe, round(avg(((ret - m) / sp) ** 3), 5) as skew, round(avg(((ret - m) / sp) ** 4),
        4) as kurtosis from t join s using (config) group by config, n, m, sd),
    q as (select *, stddev_pop(sharpe) over () * {_BEST_OF!r}::double as benchmark from mo),
    y as (select *, (sharpe - benchmark) / sqrt(252) / sqrt((1 - skew * sharpe / sqrt(252) + (kurtosis - 1) / 4 * (sharpe * sharpe / 252)) / (n - 1)) as z from q),
    w as (select config, n, sharpe, skew, kurtosis, benchmark, 0.5 + any_value(z) / 3000 * sum(exp(-0.5 * (z * i / 1000.0::double) ** 2) * case when i in (0,
        1000) then 1 when i % 2 = 1 then 4 else 2 end) / sqrt(2 * pi()) as dsr from y, range(1001) r(i) group by config, n, sharpe, skew, kurtosis, benchmark)
    select config, n, sharpe, skew, kurtosis, round(benchmark, 6) as benchmark_sharpe, round(dsr, 6) as dsr, dsr > 0.95 as is_significant from w""")
def deflated_sharpes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each configuration's Sharpe ratio is above what the best of all would show by chance: one row per configuration goes through Python."""
    schema = "config int, n long, sharpe double, skew double, kurtosis double, benchmark_sharpe double, dsr double, is_significant boolean"

    def deflate(f: pd.DataFrame) -> pd.DataFrame:
        return ev.deflate(f.sort_values("config"))[["config", "n", "sharpe", "skew", "kurtosis", "benchmark_sharpe", "dsr", "is_significant"]]

    return trial_moments(spark, sf_dir).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda f: deflate(f.drop(columns="_one")), schema).withColumns(
        {c: F.round(c, 6) for c in ("benchmark_sharpe", "dsr")}
    )


_FOLDS_SQL = f"""{_TRIALS_SQL}, c as (select timestamp, row_number() over (order by timestamp) - 1 as bar from (select distinct timestamp from t)),
    g as (select count(*) as bars, count(*) // 3 as train from c), w as (select *, greatest(1, (bars - train - {HORIZON + BUFFER}) // {FOLDS}) as test from g),
    fo as (select i as fold, 0 as train_start, greatest(1, train + i * test - {HORIZON + BUFFER}) as train_end, train + i * test as test_start,
        train + (i + 1) * test as test_end from w, range({FOLDS}) r(i) where train + (i + 1) * test <= bars)"""


def folds(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    """Anchored folds over the numbered days: bars to train on, less the gap, and the block tested, one row per fold."""
    train = F.floor(F.col("bars") / 3)
    test = F.greatest(F.lit(1), F.floor((F.col("bars") - train - (HORIZON + BUFFER)) / FOLDS))
    g = days.agg(F.count("*").alias("bars")).select("bars", train.alias("train"), test.alias("test"), F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    start = F.col("train") + F.col("fold") * F.col("test")
    made = g.select("bars", "fold", F.lit(0).alias("train_start"), F.greatest(F.lit(1), start - (HORIZON + BUFFER)).alias("train_end"), start.alias("test_start"), (start + F.col("test")).alias("test_end"))
    return made.where("test_end <= bars").drop("bars")


def _calendar(t: DataFrame) -> DataFrame:
    return t.select("timestamp").distinct().withColumn("bar", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("timestamp")) - 1)


@book.query(f"with {_FOLDS_SQL} select * from fo")
def fold_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each fold trains and tests."""
    return folds(spark, sf_dir, _calendar(trials(spark, sf_dir)))


_SCORES_SQL = f"""{_FOLDS_SQL}, n as (select t.*, bar from t join c using (timestamp)),
    x as (select config, fold, count(*) as days, round(case when stddev_samp(ret) > 1e-15 then avg(ret) / stddev_samp(ret) * sqrt(252) else 0 end,
        6) as sharpe from n join fo on bar >= test_start and bar < test_end group by all)"""


def fold_sharpes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    days = _calendar(t)
    tested = folds(spark, sf_dir, days).select("fold", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("bar"))
    n = t.join(days, "timestamp").join(tested, "bar")
    sd = F.stddev_samp("ret")
    return n.groupBy("config", "fold").agg(F.count("*").alias("days"), F.round(F.when(sd > 1e-15, F.avg("ret") / sd * F.sqrt(F.lit(252))).otherwise(F.lit(0.0)), 6).alias("sharpe"))


@book.query(f"with {_SCORES_SQL} select * from x")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of each configuration in each fold's test block."""
    return fold_sharpes(spark, sf_dir)


@book.query(f"""with {_SCORES_SQL}, h as (select config, avg(sharpe) filter (fold < {FOLDS // 2}) as a,
        avg(sharpe) filter (fold >= {FOLDS // 2}) as z from x group by config),
    r as (select row_number() over (order by a desc, config) as ra, row_number() over (order by z desc, config) as rz from h)
    select count(*) as configs, round(least(1.0, avg(abs(ra - rz)) / greatest(1, count(*) - 1)), 8) as rank_decay from r""")
def rank_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the configurations change ranks from the first half of the folds to the second, as a share of the most they could."""
    h = fold_sharpes(spark, sf_dir).groupBy("config").agg(*[F.avg(F.when(in_half, F.col("sharpe"))).alias(n) for n, in_half in (("a", F.col("fold") < FOLDS // 2), ("z", F.col("fold") >= FOLDS // 2))])
    every = Window.partitionBy(F.lit(0))
    r = h.select(*[F.row_number().over(every.orderBy(F.desc(c), "config")).alias(f"r{c}") for c in ("a", "z")])
    return r.agg(F.count("*").alias("configs"), F.round(F.least(F.lit(1.0), F.avg(F.abs(F.col("ra") - F.col("rz"))) / F.greatest(F.lit(1), F.count("*") - 1)), 8).alias("rank_decay"))


_PARTS = 8


@book.query(f"""with {_TRIALS_SQL}, h as (select timestamp from t group by timestamp having count(*) = {len(LOOKBACKS)}), n as (select timestamp,
        row_number() over (order by timestamp) - 1 as i, count(*) over () as days from h),
    p as (select timestamp, days, case when i < (days % {_PARTS}) * (days // {_PARTS} + 1) then i // (days // {_PARTS} + 1) else (i - days % {_PARTS}) // (days // {_PARTS}) end as part from n),
    m as (select r::int as mask from range({2**_PARTS}) x(r) where bit_count(r::int) = {_PARTS // 2}),
    s as (select mask, config, (mask >> part::int) & 1 = 1 as inside, round(avg(ret) / (stddev_samp(ret) + 1e-15), 9) as score from t join p using (timestamp),
        m group by all),
    top as (select mask, arg_max(config, (score, -config)) as best from s where inside group by mask),
    o as (select s.mask, count(*) filter (s.score < z.score) + 0.5 * (count(*) filter (s.score = z.score) - 1) as rank,
        count(*) as k from s join top using (mask) join s z on z.mask = s.mask and z.config = top.best and not z.inside where not s.inside group by s.mask)
    select {len(LOOKBACKS)} as configs, (select max(days)::int from n) as days, round(count(*) filter (rank / (k - 1) < 0.5) / count(*), 8) as pbo from o""")
def overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of backtest overfitting over combinatorial splits. All that one task holds is a number per day and configuration."""

    def split(f: pd.DataFrame) -> pd.DataFrame:
        wide = f.pivot(index="timestamp", columns="config", values="ret").dropna().sort_index()
        pbo = ev.backtest_overfitting(wide.to_numpy(float)) if len(wide) >= 16 else float("nan")
        return pd.DataFrame({"configs": [wide.shape[1]], "days": [len(wide)], "pbo": [pbo]})

    return trials(spark, sf_dir).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda f: split(f.drop(columns="_one")), "configs int, days int, pbo double").withColumn("pbo", F.round("pbo", 8))


@book.query(f"""with b as ({SOUND_SQL}), l as (select symbol, timestamp, ln(close) as x from b), d as (select *, x - lag(x) over ({_W}) as d from l),
    j as (select symbol, d as y, lag(x) over ({_W}) as x1, lag(d) over ({_W}) as x2 from d), c as (select symbol, count(*) as n from b group by symbol),
    k as (select * from j where y is not null and x2 is not null),
    s as (select symbol, count(*) as m, regr_syy(y, x1) as syy, regr_sxx(y, x1) as s11, regr_sxx(y, x2) as s22, regr_sxy(y, x1) as s1y, regr_sxy(y, x2) as s2y,
        regr_sxy(x1, x2) as s12 from k group by symbol),
    f as (select *, s11 * s22 - s12 * s12 as det from s), g as (select *, (s1y * s22 - s2y * s12) / det as b1, (s2y * s11 - s1y * s12) / det as b2 from f)
    select c.symbol, c.n::int as n, round(case when c.n > 6 then b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (m - 3) * s22 / det) end,
        4) as t from c left join g using (symbol)""")
def unit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dickey-Fuller t-value of each symbol's log price. A symbol has one row per day, so a group is as long as a calendar."""

    def test(f: pd.DataFrame) -> pd.DataFrame:
        t = ev.augmented_dickey_fuller(np.log(f.sort_values("timestamp")["close"].to_numpy(float)))
        return pd.DataFrame({"symbol": [f["symbol"].iloc[0]], "n": [len(f)], "t": [t]}).astype({"t": float})

    tested = sound_bars(spark, sf_dir).select("symbol", "timestamp", "close").groupBy("symbol").applyInPandas(test, "symbol string, n int, t double")
    return tested.select("symbol", "n", F.round(F.when(~F.isnan("t"), F.col("t")), 4).alias("t"))


TARGETS, MOST_SCALES = (0.05, 0.1, 0.2), (1.0, 1.5)


@book.query(f"""with {_PF_SQL}, g as (select target, most from (values {', '.join(f'({t}::double)' for t in TARGETS)}) a(target),
        (values {', '.join(f'({m}::double)' for m in MOST_SCALES)}) b(most)),
    v as (select timestamp, ret, case when count(*) over w >= 2 then stddev_samp(ret) over w * sqrt(252) end as vol from d window w as (order by timestamp rows between 21 preceding and 1 preceding)),
    s as (select target, most, ret * case when vol > 0 then least(most, target / vol) else 1.0 end as scaled from v, g)
    select target, most, count(*) as days, round(avg(scaled), 8) as mean, round(stddev_samp(scaled), 8) as sd from s group by all""")
def target_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of two parameters, laid out by row: the scaled book's mean and spread for each."""
    w = Window.partitionBy("book").orderBy("timestamp").rowsBetween(-21, -1)
    v = portfolio(spark, sf_dir).withColumn("vol", F.when(F.count("*").over(w) >= 2, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252))))
    grid = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(m).alias("most")) for t in TARGETS for m in MOST_SCALES])
    s = v.select("ret", "vol", F.explode(grid).alias("g")).select("g.target", "g.most", "ret", "vol")
    scale = F.when(F.col("vol") > 0, F.least("most", F.try_divide("target", "vol"))).otherwise(F.lit(1.0))
    return s.withColumn("scaled", F.col("ret") * scale).groupBy("target", "most").agg(F.count("*").alias("days"), F.round(F.avg("scaled"), 8).alias("mean"), F.round(F.stddev_samp("scaled"), 8).alias("sd"))
