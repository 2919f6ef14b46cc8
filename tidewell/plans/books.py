"""Panels for models and portfolios: normalised scores, weights, returns, regimes and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.asof import asof
from tidewell.operators.incremental import advance, fresh_features
from tidewell.operators.series import correlation, log_return, percent_rank_average, rolling, simple_return, winsorize
from tidewell.operators.weights import Limits, project_path, rank_weights
from tidewell.plans import registry
from tidewell.plans.base import BENCHMARK, HOLDINGS_SQL, METRICS_SQL, OPTIONS_SQL, SOUND_SQL, TRADES_SQL, Book, by_symbol, holdings, metrics, options, sound_bars, trades
from tidewell.plans.features import _MARKET_SQL, market
from tidewell.session import table

book = Book()
_W = "partition by symbol order by timestamp"
#: What the ratios that features pass on are called in the metrics table.
PASSED_ON = {
    "pe_ttm": "pe_ratio", "ps_ttm": "ps_ratio", "pb": "pb_ratio", "ev_ebitda": "ev_ebitda", "roe": "roe", "gross_margin": "gross_margin", "operating_margin": "operating_margin",
    "fcf_margin": "fcf_margin", "debt_equity": "debt_to_equity", "eps_growth_1y": "eps_growth_yoy", "revenue_growth_1y": "revenue_growth_yoy",
}
_MOM = f"b as ({SOUND_SQL}), f as (select symbol, timestamp, close, close / lag(close, 21) over ({_W}) - 1 as mom, lead(close) over ({_W}) / close - 1 as fwd from b)"
_PCT = "(rank() over (partition by timestamp order by {0}) + (count(*) over (partition by timestamp, {0}) - 1) / 2.0) / count({0}) over (partition by timestamp)"


def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_symbol()
    return sound_bars(spark, sf_dir).select("symbol", "timestamp", simple_return("close", w, 21).alias("mom"), (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"))


@book.query(f"""with {_MOM}, p as (select symbol, timestamp, {_PCT.format('mom')} as p from f where mom is not null)
    select symbol, timestamp, round(case when stddev_samp(p) over d > 1e-10 then (p - avg(p) over d) / stddev_samp(p) over d else 0 end,
        7) as score from p window d as (partition by timestamp)""")
def rank_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the z-score of the average rank of momentum."""
    d = Window.partitionBy("timestamp")
    p = momentum(spark, sf_dir).where("mom is not null").withColumn("p", percent_rank_average("mom", ["timestamp"]))
    spread = F.stddev_samp("p").over(d)
    return p.select("symbol", "timestamp", F.round(F.when(spread > 1e-10, (F.col("p") - F.avg("p").over(d)) / spread).otherwise(F.lit(0.0)), 7).alias("score"))


@book.query(f"""with recursive {_MOM}, r as (select symbol, timestamp, rank() over d + (count(*) over (partition by timestamp,
        mom) - 1) / 2.0::double as r from f where mom is not null and symbol <> '{BENCHMARK}' window d as (partition by timestamp order by mom)),
    w0 as (select symbol, timestamp, count(*) over t as n, r / sum(r) over t as w from r window t as (partition by timestamp)),
    c as (select symbol, timestamp, n, 0 as i, case when 0.1::double * n <= 1 then 1.0::double / n else w end as w from w0
        union all select symbol, timestamp, n, i + 1, case when w > 0.1::double + 1e-12 then 0.1::double when w < 0.1::double then w + surplus / rest else w end
        from (select *, sum(case when w > 0.1::double + 1e-12 then w - 0.1::double else 0 end) over (partition by timestamp) as surplus,
        count(*) filter (w < 0.1::double) over (partition by timestamp) as rest from c where 0.1::double * n > 1) where surplus > 0 and i < n),
    l as (select symbol, timestamp, arg_max(w, i) as w from c group by all) select symbol, timestamp, round(w / sum(w) over (partition by timestamp),
        8) as weight from l""")
def rank_weight_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-only weights by momentum rank, none above a tenth."""
    return ranked_weights(spark, sf_dir).withColumn("weight", F.round("weight", 8))


def ranked_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_weights(momentum(spark, sf_dir).where(F.col("symbol") != BENCHMARK), date="timestamp", key="symbol", score="mom", cap=0.1)


PROJECTED = Limits(symbol=0.1, gross=0.95, cash=0.02, turnover=0.1, positions=30, top=5, top_share=0.45, smallest_move=0.001)


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_weights(spark, sf_dir).withColumn("book", F.date_format("timestamp", "yyyy-MM"))


@book.query()
def projected_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same weights brought within limits, along the days of each month's book."""
    return project_path(_monthly(spark, sf_dir), book="book", date="timestamp", key="symbol", weight="weight", limits=PROJECTED)


@book.query()
def projection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each step of the projection changed a month's book, and by how much in all."""
    told = project_path(_monthly(spark, sf_dir), book="book", date="timestamp", key="symbol", weight="weight", limits=PROJECTED, log=True)
    return told.groupBy("book", "step").agg(F.count("*").alias("days"), F.count_if("changed").alias("changed"), F.round(F.sum(F.col("after") - F.col("before")), 8).alias("moved"))


@book.query(f"""with {_MOM}, r as (select *, rank() over (partition by timestamp order by mom desc,
        symbol) as k from f where mom is not null and symbol <> '{BENCHMARK}'), w as (select symbol, timestamp, fwd,
        case when k <= 5 then 0.2 else 0 end as w from r),
    t as (select *, coalesce(lag(w) over ({_W}), 0) as pw from w) select timestamp, round(sum(coalesce(w * fwd, 0)), 8) as ret, round(sum(abs(w - pw)),
        8) as turnover from t group by timestamp""")
def top_five_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of equal weights in the five strongest symbols, and how much of the book changes."""
    k = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("mom"), "symbol"))
    w = momentum(spark, sf_dir).where(F.col("mom").isNotNull() & (F.col("symbol") != BENCHMARK)).withColumn("w", F.when(k <= 5, 0.2).otherwise(0.0))
    t = w.withColumn("pw", F.coalesce(F.lag("w").over(by_symbol()), F.lit(0.0)))
    return t.groupBy("timestamp").agg(F.round(F.sum(F.coalesce(F.col("w") * F.col("fwd"), F.lit(0.0))), 8).alias("ret"), F.round(F.sum(F.abs(F.col("w") - F.col("pw"))), 8).alias("turnover"))


@book.query(f"""with {_MARKET_SQL}, q as (select quantile_cont(market_vol_20d, 0.5) as v from m), l as (select timestamp,
        case when market_vol_20d > v then 'high_vol' else 'low_vol' end || case when market_trend_20d > 0 then '_trend_up' else '_trend_down' end as label from m,
        q where market_vol_20d is not null)
    select label, count(*) as days, round(avg(mean_ret), 8) as mean, round(stddev_samp(mean_ret), 8) as sd,
        round(case when stddev_samp(mean_ret) > 1e-15 then avg(mean_ret) / stddev_samp(mean_ret) * sqrt(252) else 0 end,
        5) as sharpe from l join d using (timestamp) group by label""")
def regime_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's mean, spread and Sharpe ratio in each regime of volatility and trend."""
    m = market(spark, sf_dir).where("market_vol_20d is not null")
    m = m.withColumn("middle", F.percentile("market_vol_20d", 0.5).over(Window.partitionBy(F.lit(0))))
    vol = F.when(F.col("market_vol_20d") > F.col("middle"), "high_vol").otherwise("low_vol")
    trend = F.when(F.col("market_trend_20d") > 0, "_trend_up").otherwise("_trend_down")
    r = sound_bars(spark, sf_dir).select("timestamp", log_return("close", by_symbol(), 1).alias("ret")).where("ret is not null")
    d = r.groupBy("timestamp").agg(F.avg("ret").alias("x"))
    sd = F.stddev_samp("x")
    out = m.select("timestamp", F.concat(vol, trend).alias("label")).join(d, "timestamp").groupBy("label")
    return out.agg(F.count("*").alias("days"), F.round(F.avg("x"), 8).alias("mean"), F.round(sd, 8).alias("sd"), F.round(F.when(sd > 1e-15, F.avg("x") / sd * F.sqrt(F.lit(252))).otherwise(F.lit(0.0)), 5).alias("sharpe"))


_CLIP = ", ".join(f"round(case when {c} is not null then greatest(least({c}, (select quantile_cont(g.{c}, 0.99) from j g where g.symbol = j.symbol)), (select quantile_cont(g.{c}, 0.01) from j g where g.symbol = j.symbol)) end, 8) as {c}" for c in PASSED_ON)


@book.query(f"""with b as ({SOUND_SQL}), m as (select * from ({METRICS_SQL}) qualify row_number() over (partition by symbol,
        timestamp order by ingested_at desc nulls last, metric_id desc) = 1),
    j as (select b.symbol, b.timestamp, {', '.join(f'm.{c} as {n}' for n, c in PASSED_ON.items())} from b asof left join m on m.symbol = b.symbol and b.timestamp >= m.timestamp) select symbol, timestamp, {_CLIP} from j""")
def fundamental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios known at each bar, clipped to their symbol's exact quantiles."""
    j = asof(sound_bars(spark, sf_dir).select("symbol", "timestamp"), metrics(spark, sf_dir), by=["symbol"], at="timestamp", right_at="timestamp", carry=list(PASSED_ON.values()), tie=["ingested_at", "metric_id"])
    j = j.select("symbol", "timestamp", *[F.col(c).alias(n) for n, c in PASSED_ON.items()])
    return winsorize(j, list(PASSED_ON), ["symbol"]).select("symbol", "timestamp", *[F.round(c, 8).alias(c) for c in PASSED_ON])


@book.query(f"""with b as ({SOUND_SQL}), t as (select symbol, filed_day,
        total_value from ({TRADES_SQL}) where transaction_type = 'Open market purchase' and total_value is not null),
    s as (select * from ({METRICS_SQL}) where shares_outstanding > 0 qualify row_number() over (partition by symbol, timestamp order by ingested_at desc nulls last,
        metric_id desc) = 1),
    k as (select b.symbol, b.timestamp, b.close * s.shares_outstanding as cap from b asof left join s on s.symbol = b.symbol and b.timestamp >= s.timestamp)
    select k.symbol, k.timestamp, round(sum(t.total_value) / any_value(cap) * 1e6,
        4) as intensity from k left join t on t.symbol = k.symbol and t.filed_day between k.timestamp::date - 30 and k.timestamp::date group by k.symbol, k.timestamp""")
def insider_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider purchases of 30 days in millionths of the market value known at each bar."""
    shares = metrics(spark, sf_dir).where("shares_outstanding > 0")
    k = asof(sound_bars(spark, sf_dir).select("symbol", "timestamp", "close"), shares, by=["symbol"], at="timestamp", right_at="timestamp", carry=["shares_outstanding"], tie=["ingested_at", "metric_id"])
    t = trades(spark, sf_dir).where((F.col("transaction_type") == "Open market purchase") & F.col("total_value").isNotNull())
    daily = t.groupBy("symbol", F.col("filed_day").alias("day")).agg(F.sum("total_value").alias("bought"))
    u = k.select("symbol", F.to_date("timestamp").alias("day"), "timestamp", (F.col("close") * F.col("shares_outstanding")).alias("cap")).unionByName(daily, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-30, 0)
    return u.select("symbol", "timestamp", F.round(F.try_divide(F.sum("bought").over(w), F.col("cap")) * 1e6, 4).alias("intensity")).where("timestamp is not null")


@book.query(f"""with h as ({HOLDINGS_SQL}), f as (select symbol, period, filed, sum(shares) as total from h group by all), d as (select symbol,
        unnest(generate_series(min(filed), max(filed), interval 1 day))::date as day from f group by symbol),
    r as (select symbol, filed, max((period, filed, total)) over (partition by symbol order by filed) as best from f), k as (select symbol, filed,
        max(best) as best from r group by all)
    select d.symbol, d.day::varchar as day, k.best[1]::varchar as period, round(k.best[3], 4) as total from d asof join k on k.symbol = d.symbol and d.day >= k.filed""")
def freshest_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every day the latest filing of the latest quarter filed by then: quarter first, filing date second."""
    f = holdings(spark, sf_dir).groupBy("symbol", "period", "filed").agg(F.sum("shares").alias("total"))
    w = Window.partitionBy("symbol").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    daily = f.groupBy("symbol", "filed").agg(F.max(F.struct("period", "filed", "total")).alias("best")).withColumn("best", F.max("best").over(w))
    next_ = F.lead("filed").over(Window.partitionBy("symbol").orderBy("filed"))
    held = daily.withColumn("until", F.coalesce(F.date_sub(next_, 1), F.col("filed")))
    out = held.select("symbol", F.explode(F.sequence("filed", "until")).alias("day"), "best")
    return out.select("symbol", F.col("day").cast("string").alias("day"), F.col("best.period").cast("string").alias("period"), F.round("best.total", 4).alias("total"))


@book.query(f"""with o as ({OPTIONS_SQL}), d as (select underlying, quote_date, avg(iv) as iv from o group by all),
    z as (select underlying, quote_date, iv - lag(iv, 5) over w as change,
        case when count(iv) over v >= 60 then (iv - avg(iv) over v) / nullif(stddev_samp(iv) over v,
        0) end as z from d window w as (partition by underlying order by quote_date),
        v as (partition by underlying order by quote_date rows between 59 preceding and current row))
    select underlying, quote_date::varchar as quote_date, round(change, 8) as change, sign(round(change, 8))::double as direction, round(z, 6) as z from z""")
def iv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of mean volatility over five quotes, its sign, and its z-score over 60."""
    w = Window.partitionBy("underlying").orderBy("quote_date")
    d = options(spark, sf_dir).groupBy("underlying", "quote_date").agg(F.avg("iv").alias("iv"))
    change = F.round(F.col("iv") - F.lag("iv", 5).over(w), 8)
    z = F.try_divide(F.col("iv") - rolling(F.avg("iv"), w, 60, "iv"), rolling(F.stddev_samp("iv"), w, 60, "iv"))
    return d.select("underlying", F.col("quote_date").cast("string").alias("quote_date"), change.alias("change"), F.signum(change).alias("direction"), F.round(z, 6).alias("z"))


def walk_forward_fits(m: DataFrame, purge_days: int = 5) -> DataFrame:
    """Per month of m the ridge fit of fwd on p over all rows that were ready before it: slope and rows trained on.

    m has timestamp, month, p, fwd and fwd_at, the time at which fwd is known. A row is ready after the month that holds both
    fwd_at and the purge_days after its own day; so only the gap before the month tested is purged, and a later fit takes these
    rows too. Each row is summed once; a month's fit adds up the sums of the months before.
    """
    ready = F.date_format(F.greatest(F.date_add("timestamp", purge_days), F.to_date("fwd_at")), "yyyy-MM")
    terms = {"n": F.lit(1.0), "sx": F.col("p"), "sy": F.col("fwd"), "sxx": F.col("p") * F.col("p"), "sxy": F.col("p") * F.col("fwd")}
    sums = m.groupBy(ready.alias("month")).agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    every = m.select("month").distinct().withColumn("asked", F.lit(True)).join(sums, "month", "full")
    before = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    past = every.select("month", "asked", *[F.sum(k).over(before).alias(k) for k in terms]).where("asked and n > 20")
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") + 10.0)
    return past.select("month", slope.alias("slope"), F.col("n").cast("long").alias("trained"))


@book.query(f"""with b as ({SOUND_SQL}), f as (select symbol, timestamp, close / lag(close, 21) over ({_W}) - 1 as mom, lead(close) over ({_W}) / close - 1 as fwd,
        lead(timestamp) over ({_W}) as fwd_at from b),
    m as (select *, strftime(timestamp, '%Y-%m') as month, {_PCT.format('mom')} as p from f where mom is not null and fwd is not null),
    s as (select strftime(greatest(timestamp::date + 5, fwd_at::date), '%Y-%m') as ready, count(*) as n, sum(p) as sx, sum(fwd) as sy, sum(p * p) as sxx,
        sum(p * fwd) as sxy from m group by all),
    t as (select month, count(*) as tested, corr(p, fwd) as rho from m group by month),
    a as (select t.month, any_value(tested) as tested, any_value(rho) as rho, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx,
        sum(sxy) as sxy from t join s on s.ready < t.month group by t.month having sum(n) > 20),
    g as (select *, (sxy - sx * sy / n) / (sxx - sx * sx / n + 10.0) as slope from a)
    select month, n::bigint as trained, tested, round(slope, 8) as slope, round(sign(slope) * rho, 6) as score from g""")
def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regressions of the next return on the rank of momentum, fitted on all that was known five days before each month, and the rank correlation of their scores in it."""
    m = momentum(spark, sf_dir).withColumn("fwd_at", F.lead("timestamp").over(by_symbol())).where("mom is not null and fwd is not null")
    m = m.withColumn("p", percent_rank_average("mom", ["timestamp"])).withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    tested = m.groupBy("month").agg(F.count("*").alias("tested"), correlation("p", "fwd").alias("rho"))
    return walk_forward_fits(m).join(tested, "month").select("month", "trained", "tested", F.round("slope", 8).alias("slope"), F.round(F.signum("slope") * F.col("rho"), 6).alias("score"))


_LEAD = " union all ".join(f"select {k} as lag, count(*) as n, round(corr(mom, x), 6) as corr from (select symbol, mom, {('lead' if k > 0 else 'lag')}(ret, {abs(k)}) over ({_W}) as x from r) where mom is not null and x is not null" for k in (-2, -1, 0, 1, 2))


@book.query(f"""with b as ({SOUND_SQL}), r as (select symbol, timestamp, ret, mom from (select symbol, timestamp, close / lag(close) over ({_W}) - 1 as ret,
        close / lag(close, 21) over ({_W}) - 1 as mom from b) where ret is not null) {_LEAD}""")
def leakage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a feature with returns before, at and after its time: a peak at a later one gives a leak away."""
    w = by_symbol()
    r = sound_bars(spark, sf_dir).select("symbol", "timestamp", simple_return("close", w).alias("ret"), simple_return("close", w, 21).alias("mom")).where("ret is not null")
    lags = (-2, -1, 0, 1, 2)
    moved = r.select("mom", *[(F.lead("ret", k) if k > 0 else F.lag("ret", -k)).over(w).alias(f"f{k + 2}") for k in lags]).where("mom is not null")
    one = moved.agg(*[F.count(f"f{k + 2}").alias(f"n{k + 2}") for k in lags], *[correlation("mom", f"f{k + 2}").alias(f"c{k + 2}") for k in lags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"n{k + 2}").alias("n"), F.round(f"c{k + 2}", 6).alias("corr")) for k in lags])).alias("e")).select("e.*")


@book.query("""select o_orderpriority, count(*) as n, max(o_totalprice) filter (k = floor(n * 0.95) + 1) as p95, round(avg(o_totalprice),
        4) as mean from (select o_orderpriority, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as k,
        count(*) over (partition by o_orderpriority) as n from orders) group by o_orderpriority""")
def price_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile as an order statistic. A sketch with a known error bounds where it lies; only values in between are sorted."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("x"))
    near = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.percentile_approx("x", F.array(F.lit(0.94), F.lit(0.96)), 1000).alias("q"))
    j = o.join(near, "o_orderpriority")
    over = j.groupBy("o_orderpriority").agg(F.count_if(F.col("x") > F.col("q")[1]).alias("over"))
    inside = j.where(F.col("x").between(F.col("q")[0], F.col("q")[1])).groupBy("o_orderpriority", "n", "mean", "x").agg(F.count("*").alias("c")).join(over, "o_orderpriority")
    above = inside.withColumn("above", F.col("over") + F.sum("c").over(Window.partitionBy("o_orderpriority").orderBy(F.desc("x"))))
    return above.where(F.col("above") >= F.col("n") - F.floor(F.col("n") * 0.95)).groupBy("o_orderpriority", "n", "mean").agg(F.max("x").alias("p95")).select("o_orderpriority", "n", "p95", "mean")


@book.query("""with f as (select o_custkey, p_brand, sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as q,
        arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) as p
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all), d as (select o_custkey, q, (q * p)::decimal(28,
        8) as v from f)
    select o_custkey, round(sum(abs(v)), 4)::double as gross, round(sum(v), 4)::double as net, count(*) filter (q <> 0) as positions from d group by o_custkey""")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross and net value of each customer's open quantities at the last price seen; decimals, so the order of adding up doesn't matter."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    q = F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    last = F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"))
    f = j.groupBy("o_custkey", "p_brand").agg(q.alias("q"), last.alias("p")).withColumn("v", (F.col("q") * F.col("p")).cast("decimal(28,8)"))
    total = lambda v: F.round(F.sum(v), 4).cast("double")
    return f.groupBy("o_custkey").agg(total(F.abs("v")).alias("gross"), total("v").alias("net"), F.count_if(F.col("q") != 0).alias("positions"))


_REG = ("ret_5d", "rv_21d", "dist_20d_high")
_REG_SQL = f"""select symbol, timestamp, round(ret_5d, 8) as ret_5d, round(rv_21d, 8) as rv_21d, round(dist_20d_high, 8) as dist_20d_high from (select symbol,
        timestamp, ln(close / lag(close, 5) over ({_W})) as ret_5d,
    case when count(r) over (w rows between 20 preceding and current row) >= 21 then stddev_samp(r) over (w rows between 20 preceding and current row) * sqrt(252) end as rv_21d,
    case when count(close) over (w rows between 19 preceding and current row) >= 20 then close / max(close) over (w rows between 19 preceding and current row) - 1 end as dist_20d_high from (select *, ln(close / lag(close) over ({_W})) as r from ({SOUND_SQL})) window w as ({_W}))"""


@book.query(f"{_REG_SQL} where timestamp > '2024-02-01'")
def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered features after a high-water mark, from no more bars than they look back on: the same values as in full."""
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp", "close")
    marks = b.select("symbol").distinct().withColumn("watermark", F.lit("2024-02-01").cast("timestamp"))
    out = fresh_features(b, marks, lambda df: registry.compute(df, _REG), by="symbol", at="timestamp", lookback_rows=registry.lookback(_REG))
    return out.select("symbol", "timestamp", *[F.round(c, 8).alias(c) for c in _REG])


@book.query(f"""with b as ({SOUND_SQL}), m as (select symbol, max(timestamp) as last_input from ({METRICS_SQL}) group by symbol), l as (select symbol,
        max(timestamp) as last from b group by symbol) select symbol, least(last, coalesce(last_input, last)) as watermark from l left join m using (symbol)""")
def advanced_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water marks after a run, held back where the metrics end earlier than the bars."""
    b = sound_bars(spark, sf_dir)
    cap = metrics(spark, sf_dir).groupBy("symbol").agg(F.max("timestamp").alias("last_input"))
    none = b.select("symbol", F.col("timestamp").alias("watermark")).limit(0)
    return advance(none, b, by="symbol", at="timestamp", cap=cap)


@book.query("""select 'bars' as name, count(*) as n, max(timestamp) as last_at from raw_alpaca_equity_ohlcv union all select 'metrics', count(*),
        max(timestamp) from raw_fd_financial_metrics union all
    select 'statements', count(*), max(report_date) from raw_fd_fundamentals union all select 'trades', count(*),
        max(filed_at) from raw_fd_insider_trades union all select 'documents', count(*), max(published_at) from documents""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and last time of each table."""
    names = {"bars": ("raw_alpaca_equity_ohlcv", "timestamp"), "metrics": ("raw_fd_financial_metrics", "timestamp"), "statements": ("raw_fd_fundamentals", "report_date"), "trades": ("raw_fd_insider_trades", "filed_at"), "documents": ("documents", "published_at")}
    out = None
    for name, (t, at) in names.items():
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.max(at).alias("last_at")).select(F.lit(name).alias("name"), "n", "last_at")
        out = one if out is None else out.unionByName(one)
    return out


@book.query(f"""with b as ({SOUND_SQL}), x as (select symbol, timestamp, close, volume, case when close >= lag(close) over ({_W}) then 1 else -1 end as side from b)
    select symbol, timestamp, round(close * (1 + side * 0.0005 * least(1e6 / nullif(volume, 0), 5)), 8) as fill_price, side::int as side from x""")
def simulated_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill price per bar, slipping more on thin volume, at most five times as much."""
    side = F.when(F.col("close") >= F.lag("close").over(by_symbol()), 1).otherwise(-1)
    x = sound_bars(spark, sf_dir).select("symbol", "timestamp", "close", "volume", side.alias("side"))
    thin = F.try_divide(F.lit(1e6), F.col("volume").cast("double"))
    slip = F.when(thin.isNotNull(), F.least(thin, F.lit(5.0))).otherwise(F.lit(5.0))
    return x.select("symbol", "timestamp", F.round(F.col("close") * (1 + F.col("side") * 0.0005 * slip), 8).alias("fill_price"), "side")
