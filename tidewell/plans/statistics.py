"""Aggregates, risk and performance statistics, and evaluation of portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import evaluation as ev
from tidewell.operators.series import correlation, drawdowns, percent_rank_average, simple_return
from tidewell.operators.series import rolling_correlation as series_correlation
from tidewell.plans.base import BENCHMARK, SOUND_SQL, Book, by_symbol, sound_bars
from tidewell.session import table

book = Book()
_W = "partition by symbol order by timestamp"
_RET_SQL = f"b as ({SOUND_SQL}), r as (select symbol, timestamp, close / lag(close) over ({_W}) - 1 as ret from b)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sound_bars(spark, sf_dir).select("symbol", "timestamp", simple_return("close", by_symbol()).alias("ret"))


@book.query(f"""with b as ({SOUND_SQL}) select symbol, count(*) as n, min(timestamp) as first_ts, max(timestamp) as last_ts, date_diff('day', min(timestamp),
        max(timestamp)) + 1 as span, round(count(*) / (date_diff('day', min(timestamp), max(timestamp)) + 1), 8) as fill_ratio from b group by symbol""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per symbol and the share of calendar days they fill."""
    span = F.datediff(F.max("timestamp"), F.min("timestamp")) + 1
    return sound_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), span.cast("long").alias("span"), F.round(F.count("*") / span, 8).alias("fill_ratio"))


@book.query(f"""with b as ({SOUND_SQL}), c as (select symbol, count(*) as n from b group by symbol), m as (select n as mode from c group by n order by count(*) desc,
        n desc limit 1) select symbol, n, mode from c, m where n < 0.8 * mode""")
def coverage_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with less than four fifths of the most common number of bars (the larger on ties)."""
    c = sound_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    best = c.groupBy("n").agg(F.count("*").alias("k")).agg(F.max(F.struct("k", "n")).getField("n")).first()[0]
    return c.withColumn("mode", F.lit(best or 0).cast("long")).where("n < 0.8 * mode")


@book.query(f"""with {_RET_SQL} select symbol, count(ret) as n, round(avg(ret), 8) as mean, round(stddev_samp(ret), 8) as sd, round(min(ret), 8) as low,
        round(max(ret), 8) as high, round(quantile_cont(ret, 0.25), 8) as q25, round(median(ret), 8) as median,
    round(kurtosis_pop(ret), 5) as kurt from r group by symbol having count(ret) > 3""")
def return_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and exact quantiles of each symbol's returns."""
    r = returns(spark, sf_dir).groupBy("symbol").agg(
        F.count("ret").alias("n"), F.round(F.avg("ret"), 8).alias("mean"), F.round(F.stddev_samp("ret"), 8).alias("sd"), F.round(F.min("ret"), 8).alias("low"), F.round(F.max("ret"), 8).alias("high"),
        F.round(F.percentile("ret", 0.25), 8).alias("q25"), F.round(F.percentile("ret", 0.5), 8).alias("median"), F.round(F.kurtosis("ret"), 5).alias("kurt"),
    )
    return r.where("n > 3")


@book.query(f"""with {_RET_SQL}, k as (select symbol, ret, row_number() over (partition by symbol order by ret, timestamp) as i,
        count(*) over (partition by symbol) as n from r where ret is not null)
    select symbol, n, round(max(ret) filter (i = floor(n * 0.05) + 1), 8) as var_5, round(avg(ret) filter (i <= greatest(floor(n * 0.05), 1)),
        8) as cvar_5 from k group by symbol, n""")
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at risk as an order statistic, and the mean of the returns below it (of the worst one if there are few)."""
    w = Window.partitionBy("symbol")
    k = returns(spark, sf_dir).where("ret is not null").withColumn("i", F.row_number().over(w.orderBy("ret", "timestamp"))).withColumn("n", F.count("*").over(w))
    cut = F.floor(F.col("n") * 0.05)
    return k.groupBy("symbol", "n").agg(F.round(F.max(F.when(F.col("i") == cut + 1, F.col("ret"))), 8).alias("var_5"), F.round(F.avg(F.when(F.col("i") <= F.greatest(cut, F.lit(1)), F.col("ret"))), 8).alias("cvar_5"))


@book.query(f"""with {_RET_SQL}, k as (select timestamp, ret as rb from r where symbol = '{BENCHMARK}' and ret is not null), j as (select r.*,
        rb from r join k using (timestamp) where ret is not null and symbol <> '{BENCHMARK}')
    select symbol, count(*) as n, round(corr(ret, rb), 6) as corr, round(covar_samp(ret, rb), 8) as cov, round(regr_slope(ret, rb), 6) as beta, round(regr_r2(ret,
        rb), 6) as r2 from j group by symbol having count(*) > 3""")
def benchmark_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, covariance, slope and fit of each symbol on the benchmark."""
    r = returns(spark, sf_dir).where("ret is not null")
    k = r.where(F.col("symbol") == BENCHMARK).select("timestamp", F.col("ret").alias("rb"))
    j = r.where(F.col("symbol") != BENCHMARK).join(k, "timestamp")
    out = j.groupBy("symbol").agg(F.count("*").alias("n"), F.round(correlation("ret", "rb"), 6).alias("corr"), F.round(F.covar_samp("ret", "rb"), 8).alias("cov"), F.round(F.regr_slope("ret", "rb"), 6).alias("beta"), F.round(F.regr_r2("ret", "rb"), 6).alias("r2"))
    return out.where("n > 3")


_PF_SQL = f"{_RET_SQL}, d as (select timestamp, avg(ret) as ret from r where symbol <> '{BENCHMARK}' and ret is not null group by timestamp)"


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return of equal weights over all symbols but the benchmark; every return counts, however large."""
    r = returns(spark, sf_dir).where((F.col("symbol") != BENCHMARK) & F.col("ret").isNotNull())
    return r.groupBy("timestamp").agg(F.avg("ret").alias("ret")).withColumn("book", F.lit("equal"))


@book.query(f"""with {_PF_SQL}, e as (select *, exp(sum(ln(1 + ret)) over (order by timestamp)) as equity from d), p as (select *,
        greatest(max(equity) over (order by timestamp), 1.0) as peak from e)
    , u as (select *, sum(case when equity / peak - 1 > -1e-12 then 1 else 0 end) over (order by timestamp) as episode from p), v as (select *,
        count(*) filter (equity / peak - 1 <= -1e-12) over (partition by episode) as under from u)
    select 'equal' as book, count(*) as n, max(under) as underwater_days, round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 6) as annual_return,
        round((exp(sum(ln(1 + ret)) * 252 / count(*)) - 1) / abs(min(equity / peak - 1)), 5) as calmar,
        round(case when stddev_samp(ret) > 1e-15 then avg(ret) / stddev_samp(ret) * sqrt(252) else 0 end, 6) as sharpe, round(avg(ret) / sqrt(sum(least(ret,
        0) ** 2) / count(*)) * sqrt(252), 6) as sortino,
    round(min(equity / peak - 1), 8) as max_drawdown, round(exp(sum(ln(1 + ret))) - 1, 2) as total_return, round(count(*) filter (ret > 0) / count(*), 8) as win_rate,
        round(sum(greatest(ret, 0)) / -sum(least(ret, 0)), 6) as profit_factor from v""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe, Sortino, drawdown, total return, win rate and profit factor of a book."""
    return ev.performance(portfolio(spark, sf_dir), by=["book"], order="timestamp", ret="ret").withColumn("total_return", F.round("total_return", 2))


@book.query(f"""with {_PF_SQL}, e as (select *, exp(sum(ln(1 + ret)) over (order by timestamp)) as equity from d), p as (select *,
        greatest(max(equity) over (order by timestamp), 1.0) as peak from e),
    q as (select *, equity / peak - 1 as dd, sum(case when equity / peak - 1 > -1e-12 then 1 else 0 end) over (order by timestamp) as episode from p)
    select episode::bigint as episode, min(timestamp) filter (dd <= -1e-12) as start_ts, arg_min(timestamp, dd) as trough_ts, round(min(dd), 8) as depth,
        count(*) filter (dd <= -1e-12) as days from q group by episode having min(dd) <= -1e-12 order by depth, episode limit 5""")
def worst_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five deepest stretches below the peak: islands of an ordered series."""
    d = drawdowns(portfolio(spark, sf_dir), by=["book"], order="timestamp", ret="ret")
    under = F.col("drawdown") <= -1e-12
    e = d.groupBy("episode").agg(F.min(F.when(under, F.col("timestamp"))).alias("start_ts"), F.min_by("timestamp", "drawdown").alias("trough_ts"), F.round(F.min("drawdown"), 8).alias("depth"), F.count_if(under).alias("days"))
    return e.where("days > 0").orderBy("depth", "episode").limit(5)


@book.query(f"""with {_RET_SQL}, f as (select symbol, timestamp, lead(close, 5) over ({_W}) / close - 1 as fwd, close / lag(close,
        21) over ({_W}) - 1 as mom from b),
    k as (select timestamp, (rank() over (partition by timestamp order by fwd) + (count(*) over (partition by timestamp, fwd) - 1) / 2.0) as rf,
        (rank() over (partition by timestamp order by mom) + (count(*) over (partition by timestamp,
        mom) - 1) / 2.0) as rm from f where fwd is not null and mom is not null)
    select timestamp, count(*) as n, round(corr(rf, rm), 6) as ic from k group by timestamp having count(*) > 2""")
def information_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the rank correlation of momentum with the return of the next five bars."""
    w = by_symbol()
    f = sound_bars(spark, sf_dir).select("symbol", "timestamp", (F.lead("close", 5).over(w) / F.col("close") - 1).alias("fwd"), simple_return("close", w, 21).alias("mom")).where("fwd is not null and mom is not null")
    k = f.withColumn("rf", percent_rank_average("fwd", ["timestamp"])).withColumn("rm", percent_rank_average("mom", ["timestamp"]))
    return k.groupBy("timestamp").agg(F.count("*").alias("n"), F.round(correlation("rf", "rm"), 6).alias("ic")).where("n > 2")


#: Stretches of market stress with their first and last day.
STRESS = (
    ("gfc_2008", "2008-09-01", "2009-03-31"), ("covid_2020", "2020-02-19", "2020-03-23"), ("dotcom_2000", "2000-03-10", "2002-10-09"),
    ("flash_crash_2010", "2010-05-06", "2010-05-07"), ("vix_2018", "2018-02-02", "2018-02-09"),
)
#: Stretches that the tables at hand cover; the last two overlap.
COVERED = (("spring_2024", "2024-03-01", "2024-04-30"), ("winter_2023", "2023-12-01", "2024-01-31"), ("quarter_2024", "2024-01-01", "2024-03-31"))
_STRETCHES = ", ".join(f"('{n}', date '{a}', date '{z}')" for n, a, z in STRESS + COVERED)


@book.query(f"""with {_PF_SQL}, s(scenario, a, z) as (values {_STRETCHES}),
    j as (select scenario, timestamp, ret, exp(sum(ln(1 + ret)) over (partition by scenario order by timestamp)) - 1 as grown from d join s on d.timestamp::date between a and z)
    select scenario, count(*) as n_days, round(exp(sum(ln(1 + ret))) - 1, 7) as total_return, round(min(grown), 7) as max_drawdown, round(min(ret), 8) as worst_day,
        round(max(ret), 8) as best_day, round(stddev_pop(ret) * sqrt(252), 7) as volatility
    from j group by scenario""")
def stress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-weight book within named stretches of days, which may overlap: each day is laid out on the stretches that hold it."""
    day = F.to_date("timestamp")
    names = F.array_compact(F.array(*[F.when(day.between(F.lit(a).cast("date"), F.lit(z).cast("date")), F.lit(n)) for n, a, z in STRESS + COVERED]))
    d = portfolio(spark, sf_dir).select("timestamp", "ret", F.explode(names).alias("scenario"))
    so_far = Window.partitionBy("scenario").orderBy("timestamp")
    d = d.withColumn("grown", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(so_far)) - 1)
    return d.groupBy("scenario").agg(
        F.count("*").alias("n_days"), F.round(F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1, 7).alias("total_return"), F.round(F.min("grown"), 7).alias("max_drawdown"),
        F.round(F.min("ret"), 8).alias("worst_day"), F.round(F.max("ret"), 8).alias("best_day"), F.round(F.stddev_pop("ret") * F.sqrt(F.lit(252)), 7).alias("volatility"),
    )


@book.query(f"""with {_PF_SQL}, k as (select timestamp, ret as rb from r where symbol = '{BENCHMARK}' and ret is not null), j as (select d.timestamp, d.ret,
        rb from d join k using (timestamp)),
    c as (select timestamp, case when count(*) over w >= 60 then corr(ret,
        rb) over w end as rho from j window w as (order by timestamp rows between 59 preceding and current row))
    select count(rho) as n, round(avg(rho), 6) as mean, round(stddev_pop(rho), 6) as sd, round(min(rho), 6) as low, round(max(rho), 6) as high, round(arg_max(rho,
        timestamp) filter (rho is not null), 6) as last from c""")
def rolling_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the book with the benchmark over 60 days, summed up. Both series have one row per day."""
    k = returns(spark, sf_dir).where((F.col("symbol") == BENCHMARK) & F.col("ret").isNotNull()).select("timestamp", F.col("ret").alias("rb"))
    j = portfolio(spark, sf_dir).join(k, "timestamp")
    c = j.withColumn("rho", series_correlation("ret", "rb", Window.partitionBy("book").orderBy("timestamp"), 60))
    return c.agg(F.count("rho").alias("n"), F.round(F.avg("rho"), 6).alias("mean"), F.round(F.stddev_pop("rho"), 6).alias("sd"), F.round(F.min("rho"), 6).alias("low"), F.round(F.max("rho"), 6).alias("high"), F.round(F.max_by("rho", F.when(F.col("rho").isNotNull(), F.col("timestamp"))), 6).alias("last"))


@book.query(f"""with {_PF_SQL}, v as (select timestamp, ret, case when count(*) over w >= 2 then stddev_samp(ret) over w * sqrt(252) end as vol from d window w as (order by timestamp rows between 21 preceding and 1 preceding))
    select timestamp, round(case when vol > 0 then least(1.0, 0.1 / vol) else 1.0 end, 8) as scale from v""")
def vol_target_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure that brings the volatility of the 21 days before to a tenth, never above 1."""
    w = Window.partitionBy("book").orderBy("timestamp").rowsBetween(-21, -1)
    vol = F.when(F.count("*").over(w) >= 2, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252)))
    return portfolio(spark, sf_dir).withColumn("vol", vol).select("timestamp", F.round(F.when(F.col("vol") > 0, F.least(F.lit(1.0), F.try_divide(F.lit(0.1), F.col("vol")))).otherwise(F.lit(1.0)), 8).alias("scale"))


@book.query(f"""with {_RET_SQL}, k as (select timestamp, avg(ret) as x1, stddev_samp(ret) as x2 from r where ret is not null group by timestamp),
    j as (select symbol, ret as y, x1, x2 from r join k using (timestamp) where ret is not null and x1 is not null and x2 is not null),
    s as (select symbol, count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, regr_syy(y, x1) as syy, regr_sxx(y, x1) as s11, regr_sxx(y, x2) as s22,
        regr_sxy(y, x1) as s1y, regr_sxy(y, x2) as s2y, regr_sxy(x1, x2) as s12 from j group by symbol),
    d as (select *, s11 * s22 - s12 * s12 as d from s),
    fit as (select *, (s1y * s22 - s2y * s12) / d as b1, (s2y * s11 - s1y * s12) / d as b2 from d),
    e as (select *, my - b1 * m1 - b2 * m2 as b0, greatest(syy - b1 * s1y - b2 * s2y, 0) as rss from fit)
    select symbol, n, round(b0, 6) as beta_intercept, round(b1, 5) as beta_mkt, round(b2, 5) as beta_spread, round(1 - rss / syy, 6) as r2,
    round(b0 / sqrt(rss / (n - 3) * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d)), 3) as t_intercept, round(b1 / sqrt(rss / (n - 3) * s22 / d),
        3) as t_mkt, round(b2 / sqrt(rss / (n - 3) * s11 / d), 3) as t_spread from e""")
def factor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of each symbol's returns on market and momentum spread: products are summed where the rows are, a 3 x 3 system is solved per symbol."""
    r = returns(spark, sf_dir).where("ret is not null")
    market = r.groupBy("timestamp").agg(F.avg("ret").alias("mkt"), F.stddev_samp("ret").alias("spread"))
    fit = ev.least_squares(r.join(market, "timestamp").dropna(subset=["mkt", "spread"]), by=["symbol"], y="ret", xs=["mkt", "spread"])
    places = {"beta_intercept": 6, "beta_mkt": 5, "beta_spread": 5, "r2": 6, "t_intercept": 3, "t_mkt": 3, "t_spread": 3}
    return fit.select("symbol", "n", *[F.round(c, k).alias(c) for c, k in places.items()])


@book.query()
def sharpe_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded bootstrap intervals and the probability that a Sharpe ratio is above zero, per symbol."""
    r = returns(spark, sf_dir).where("ret is not null")
    return ev.sharpe_intervals(r, by="symbol", order="timestamp", ret="ret")


@book.query("""with recursive f as (select o_custkey, p_brand, case when l_returnflag = 'R' then -l_quantity else l_quantity end as q,
        l_extendedprice / l_quantity as p,
        row_number() over (partition by o_custkey, p_brand order by o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as n,
        count(*) over (partition by o_custkey, p_brand) as fills
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
    s as (select o_custkey, p_brand, n, fills, q, p as c, 0.0::double as g from f where n = 1
        union all select f.o_custkey, f.p_brand, f.n, f.fills, s.q + f.q,
            case when s.q = 0 or sign(s.q) = sign(f.q) then (s.c * abs(s.q) + f.p * abs(f.q)) / abs(s.q + f.q) when s.q + f.q = 0 then 0 when sign(s.q + f.q) = sign(s.q) then s.c else f.p end,
            case when s.q = 0 or sign(s.q) = sign(f.q) then s.g else s.g + least(abs(s.q), abs(f.q)) * sign(s.q) * (f.p - s.c) end
        from s join f on f.o_custkey = s.o_custkey and f.p_brand = s.p_brand and f.n = s.n + 1)
    select o_custkey, p_brand, fills, round(q, 6) as quantity, round(c, 8) as average_cost, round(g, 8) as realised from s where n = fills""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, average cost and realised gain per customer and brand from their lines in order: an ordered fold."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    fills = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        "o_custkey", "p_brand", F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    return ev.fold_positions(fills, by=["o_custkey", "p_brand"], order="seq", quantity="quantity", price="price")
