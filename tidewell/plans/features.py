"""Rolling, cross-sectional, regime and filing features without lookahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.asof import asof, asof_nearest
from tidewell.operators.series import log_return, percent_rank_average, rolling, simple_return, winsorize, z_score
from tidewell.plans.base import BENCHMARK, HOLDINGS_SQL, METRICS_SQL, OPTIONS_SQL, SOUND_SQL, TRADES_SQL, Book, by_symbol, holdings, metrics, options, sound_bars, trades

book = Book()
YEAR = 252
_W = "partition by symbol order by timestamp"


def _lr(k: int) -> str:
    return f"ln(close / lag(close, {k}) over ({_W}))"


def _gated(expr: str, n: int, counted: str, least: int | None = None) -> str:
    frame = f"({_W} rows between {n - 1} preceding and current row)"
    return f"case when count({counted}) over {frame} >= {least or n} then {expr} over {frame} end"


_OHLCV_SQL = f"""with b as ({SOUND_SQL}), r as (select *, {_lr(1)} as ret_1d, {_lr(5)} as ret_5d, {_lr(21)} as ret_21d, {_lr(63)} as mom_3m,
    ln(lag(close, 21) over ({_W}) / lag(close, 252) over ({_W})) as mom_12m_excl_1m from b),
    f as (select *, {_gated('stddev_samp(ret_1d)', 21, 'ret_1d')} * sqrt({YEAR}) as rv_21d, {_gated('stddev_samp(ret_1d)', 63, 'ret_1d')} * sqrt({YEAR}) as rv_63d,
    close / ({_gated('max(close)', 20, 'close')}) - 1 as dist_20d_high, close / ({_gated('min(close)', 20, 'close')}) - 1 as dist_20d_low from r)"""


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_symbol()
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp", "close")
    r = b.select("*", *[log_return("close", w, k).alias(n) for n, k in (("ret_1d", 1), ("ret_5d", 5), ("ret_21d", 21), ("mom_3m", 63))], F.ln(F.lag("close", 21).over(w) / F.lag("close", 252).over(w)).alias("mom_12m_excl_1m"))
    vol = lambda n: rolling(F.stddev_samp("ret_1d"), w, n, "ret_1d") * F.sqrt(F.lit(YEAR))
    return r.select(
        "*", vol(21).alias("rv_21d"), vol(63).alias("rv_63d"), (F.col("close") / rolling(F.max("close"), w, 20, "close") - 1).alias("dist_20d_high"), (F.col("close") / rolling(F.min("close"), w, 20, "close") - 1).alias("dist_20d_low")
    )


_OHLCV = ("ret_1d", "ret_5d", "ret_21d", "mom_3m", "mom_12m_excl_1m", "rv_21d", "rv_63d", "dist_20d_high", "dist_20d_low")


@book.query(f"{_OHLCV_SQL} select symbol, timestamp, {', '.join(f'round({c}, 8) as {c}' for c in _OHLCV)} from f")
def ohlcv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, volatilities and distances from extremes, each only over a full window."""
    return ohlcv(spark, sf_dir).select("symbol", "timestamp", *[F.round(c, 8).alias(c) for c in _OHLCV])


_CLIPPED = ", ".join(f"round(case when {c} is not null then greatest(least({c}, (select quantile_cont(g.{c}, 0.99) from f g where g.symbol = f.symbol)), (select quantile_cont(g.{c}, 0.01) from f g where g.symbol = f.symbol)) end, 8) as {c}" for c in ("ret_1d", "rv_21d"))


@book.query(f"{_OHLCV_SQL} select symbol, timestamp, {_CLIPPED} from f")
def winsorized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features clipped to the exact 1 and 99 percent quantiles of their symbol."""
    f = winsorize(ohlcv(spark, sf_dir).select("symbol", "timestamp", "ret_1d", "rv_21d"), ["ret_1d", "rv_21d"], ["symbol"])
    return f.select("symbol", "timestamp", F.round("ret_1d", 8).alias("ret_1d"), F.round("rv_21d", 8).alias("rv_21d"))


_ASOF_METRICS = f"m as (select * from ({METRICS_SQL}) qualify row_number() over (partition by symbol, timestamp order by ingested_at desc nulls last, metric_id desc) = 1)"


@book.query(f"""with b as ({SOUND_SQL}), {_ASOF_METRICS}
    select b.symbol, b.timestamp, m.timestamp as matched_at, m.metric_id, m.pe_ratio,
        m.shares_outstanding from b asof left join m on m.symbol = b.symbol and b.timestamp >= m.timestamp""")
def fundamental_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the latest metrics row at or before it; the row's nulls stay."""
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp")
    return asof(b, metrics(spark, sf_dir), by=["symbol"], at="timestamp", right_at="timestamp", carry=["metric_id", "pe_ratio", "shares_outstanding"], tie=["ingested_at", "metric_id"])


_RANK = "case when {0} is not null then (rank() over (partition by timestamp order by {0} nulls last) + (count(*) over (partition by timestamp, {0}) - 1) / 2.0) / count({0}) over (partition by timestamp) end"


@book.query(f"""with b as ({SOUND_SQL}), {_ASOF_METRICS}, j as (select b.symbol, b.timestamp,
        case when m.shares_outstanding > 0 then ln(m.shares_outstanding * b.close) end as log_mkt_cap,
    case when m.pe_ratio <> 0 then 1 / m.pe_ratio end as earnings_yield from b asof left join m on m.symbol = b.symbol and b.timestamp >= m.timestamp)
    select symbol, timestamp, round({_RANK.format('log_mkt_cap')}, 8) as size_rank, round({_RANK.format('earnings_yield')}, 8) as value_rank,
    round(case when log_mkt_cap is not null then case when stddev_samp(log_mkt_cap) over (partition by timestamp) > 0 then (log_mkt_cap - avg(log_mkt_cap) over (partition by timestamp)) / stddev_samp(log_mkt_cap) over (partition by timestamp) else 0 end end, 5) as size_z from j""")
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day average ranks of size and earnings yield, and the z-score of size."""
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp", "close")
    j = asof(b, metrics(spark, sf_dir), by=["symbol"], at="timestamp", right_at="timestamp", carry=["pe_ratio", "shares_outstanding"], tie=["ingested_at", "metric_id"])
    cap = F.when(F.col("shares_outstanding") > 0, F.ln(F.col("shares_outstanding") * F.col("close")))
    j = j.select("symbol", "timestamp", cap.alias("log_mkt_cap"), F.try_divide(F.lit(1.0), F.col("pe_ratio")).alias("earnings_yield"))
    ranks = [F.round(percent_rank_average(c, ["timestamp"]), 8).alias(n) for c, n in (("log_mkt_cap", "size_rank"), ("earnings_yield", "value_rank"))]
    return j.select("symbol", "timestamp", *ranks, F.round(z_score("log_mkt_cap", ["timestamp"]), 5).alias("size_z"))


_MARKET_SQL = f"""b as ({SOUND_SQL}), r as (select symbol, timestamp, {_lr(1)} as ret from b),
    d as (select timestamp, avg(ret) as mean_ret, stddev_samp(ret) as spread from r where ret is not null group by timestamp),
    m as (select timestamp, case when count(*) over w >= 20 then stddev_samp(mean_ret) over w * sqrt({YEAR}) end as market_vol_20d,
        case when count(*) over w >= 20 then sum(mean_ret) over w end as market_trend_20d,
    case when count(spread) over w >= 20 then avg(spread) over w end as dispersion_20d from d window w as (order by timestamp rows between 19 preceding and current row))"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-wide series; one row per day after aggregation, so a single ordered window holds a calendar, not the data."""
    r = sound_bars(spark, sf_dir).select("symbol", "timestamp", log_return("close", by_symbol(), 1).alias("ret")).where("ret is not null")
    d = r.groupBy("timestamp").agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("spread"))
    w = Window.partitionBy(F.lit(0)).orderBy("timestamp")
    return d.select(
        "timestamp", (rolling(F.stddev_samp("mean_ret"), w, 20, "mean_ret") * F.sqrt(F.lit(YEAR))).alias("market_vol_20d"), rolling(F.sum("mean_ret"), w, 20, "mean_ret").alias("market_trend_20d"), rolling(F.avg("spread"), w, 20, "spread").alias("dispersion_20d")
    )


_ROUNDED = ", ".join(f"round({c}, 8) as {c}" for c in ("market_vol_20d", "market_trend_20d", "dispersion_20d"))


@book.query(f"with {_MARKET_SQL} select timestamp, {_ROUNDED} from m")
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility, trend and dispersion of the market over 20 days."""
    return market(spark, sf_dir).select("timestamp", *[F.round(c, 8).alias(c) for c in ("market_vol_20d", "market_trend_20d", "dispersion_20d")])


@book.query(f"""with {_MARKET_SQL}, q as (select quantile_cont(market_vol_20d, 1 / 3.0) as a, quantile_cont(market_vol_20d, 2 / 3.0) as z from m)
    select timestamp, case when market_vol_20d is null then null when market_vol_20d <= a then 'low_vol' when market_vol_20d <= z then 'mid_vol' else 'high_vol' end as label from m, q""")
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days labelled by terciles of market volatility."""
    m = market(spark, sf_dir)
    v, q = F.col("market_vol_20d"), F.col("q")
    m = m.withColumn("q", F.percentile("market_vol_20d", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy(F.lit(0))))
    return m.select("timestamp", F.when(v.isNotNull(), F.when(v <= q[0], "low_vol").when(v <= q[1], "mid_vol").otherwise("high_vol")).alias("label"))


@book.query(f"""with {_MARKET_SQL}, k as (select symbol, timestamp + interval 12 hours as t from b)
    select k.symbol, k.t, m.timestamp as matched_at, round(m.market_vol_20d, 8) as market_vol_20d from k asof left join m on k.t >= m.timestamp""")
def regime_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's row carried to every symbol at midday: an as-of join without a key."""
    k = sound_bars(spark, sf_dir).select("symbol", (F.col("timestamp") + F.expr("interval 12 hours")).alias("t"))
    out = asof(k, market(spark, sf_dir), by=[], at="t", right_at="timestamp", carry=["market_vol_20d"], tie=["timestamp"], shard_days=28)
    return out.withColumn("market_vol_20d", F.round("market_vol_20d", 8))


CORRELATED_DAYS = 20


@book.query(f"""with b as ({SOUND_SQL}), r as (select * from (select symbol, timestamp, {_lr(1)} as ret from b where symbol <> '{BENCHMARK}') where ret is not null),
    c as (select timestamp, row_number() over (order by timestamp) as k from (select distinct timestamp from r)), n as (select symbol, k,
        ret from r join c using (timestamp)),
    w as (select symbol, k, ret, list(ret) over p as rets from n window p as (partition by symbol order by k range between {CORRELATED_DAYS - 1} preceding and current row)),
    full_ as (select symbol, k, rets from w where len(rets) = {CORRELATED_DAYS} and list_var_pop(rets) > 1e-18),
    x as (select symbol, k, unnest(rets) as ret, generate_subscripts(rets, 1) as i from full_),
    pairs as (select a.k, a.symbol as s, z.symbol as t, corr(a.ret, z.ret) as rho from x a join x z on a.k = z.k and a.i = z.i and a.symbol < z.symbol group by all)
    select c.timestamp, round(avg(rho), 6) as corr_mean_20d, count(*) as pairs from pairs join c using (k) group by c.timestamp""")
def pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation over 20 market days of all pairs of symbols that have all of them, without making pairs.

    With each symbol's returns standardised within the window, the squares of their sums over the symbols hold all pairs:
    the mean correlation is (mean over the days of squared sums - n) / (n (n - 1)). Each return is laid out on the 20
    windows that it belongs to; what is added up per window and day is one number.
    """
    n_days = CORRELATED_DAYS
    r = sound_bars(spark, sf_dir).where(F.col("symbol") != BENCHMARK).select("symbol", "timestamp", log_return("close", by_symbol(), 1).alias("ret")).where("ret is not null")
    calendar = r.select("timestamp").distinct().select("timestamp", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("timestamp")).alias("k"))
    numbered = r.join(calendar, "timestamp").select("symbol", "k", "ret")
    back = Window.partitionBy("symbol").orderBy("k").rangeBetween(-(n_days - 1), 0)
    whole = numbered.select("symbol", "k", F.collect_list("ret").over(back).alias("rets"), F.avg("ret").over(back).alias("m"), F.var_pop("ret").over(back).alias("v"))
    whole = whole.where((F.size("rets") == n_days) & (F.col("v") > 1e-18))
    laid = whole.select("symbol", "k", F.posexplode("rets").alias("i", "ret"), "m", "v")
    sums = laid.groupBy("k", "i").agg(F.sum((F.col("ret") - F.col("m")) / F.sqrt("v")).alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("k").agg(F.avg(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n")).where("n > 1")
    pairs = F.col("n") * (F.col("n") - 1)
    return out.join(calendar, "k").select("timestamp", F.round((F.col("square") - F.col("n")) / pairs, 6).alias("corr_mean_20d"), (pairs / 2).cast("long").alias("pairs"))


BUYS, SELLS = ("Open market purchase",), ("Open market sale",)
#: Parts of titles that mark an executive or the chair.
_EXEC = "ceo|cfo|coo|president|chair|chief executive|chief financial|chief operating"
_TYPED = f"""t as (select *, case when transaction_type in ('{BUYS[0]}') then total_value end as buy,
        case when transaction_type in ('{SELLS[0]}') then total_value end as sell,
    coalesce(is_board_director, false) or regexp_matches(lower(coalesce(insider_title, '')), '{_EXEC}') as exec from ({TRADES_SQL}))"""


@book.query(f"""with b as ({SOUND_SQL}), {_TYPED}
    select b.symbol, b.timestamp, round(case when sum(coalesce(buy, 0) + coalesce(sell, 0)) > 0 then (sum(coalesce(buy, 0)) - sum(coalesce(sell,
        0))) / sum(coalesce(buy, 0) + coalesce(sell, 0)) end, 8) as net_buy_90d,
    round(case when sum(case when exec then coalesce(buy, 0) + coalesce(sell, 0) end) > 0 then sum(case when exec then coalesce(buy, 0) - coalesce(sell,
        0) end) / sum(case when exec then coalesce(buy, 0) + coalesce(sell, 0) end) end, 8) as exec_net_buy_90d
    from b left join t on t.symbol = b.symbol and t.filed_day between b.timestamp::date - 90 and b.timestamp::date and coalesce(buy,
        sell) is not null group by b.symbol, b.timestamp""")
def insider_net_buy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net insider buying over 90 days up to each bar, all and executives; null without trades."""
    t = trades(spark, sf_dir)
    buy, sell = (F.when(F.col("transaction_type").isin(*kinds), F.col("total_value")) for kinds in (BUYS, SELLS))
    is_exec = F.coalesce("is_board_director", F.lit(False)) | F.lower(F.coalesce("insider_title", F.lit(""))).rlike(_EXEC)
    t = t.select("symbol", F.col("filed_day").alias("day"), F.coalesce(buy, F.lit(0.0)).alias("buy"), F.coalesce(sell, F.lit(0.0)).alias("sell"), is_exec.alias("exec"), F.coalesce(buy, sell).alias("any")).where("any is not null")
    daily = t.groupBy("symbol", "day").agg(*[F.sum(F.when(F.col("exec") | F.lit(not only), F.col(c))).alias(f"{p}{c}") for p, only in (("", False), ("x", True)) for c in ("buy", "sell")])
    b = sound_bars(spark, sf_dir).select("symbol", F.to_date("timestamp").alias("day"), "timestamp")
    w = Window.partitionBy("symbol").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-90, 0)
    u = b.unionByName(daily, allowMissingColumns=True)
    net = lambda p: F.try_divide(F.sum(f"{p}buy").over(w) - F.sum(f"{p}sell").over(w), F.sum(f"{p}buy").over(w) + F.sum(f"{p}sell").over(w))
    out = u.select("symbol", "timestamp", F.round(net(""), 8).alias("net_buy_90d"), F.round(net("x"), 8).alias("exec_net_buy_90d"))
    return out.where("timestamp is not null")


@book.query(f"""with b as ({SOUND_SQL}), {_TYPED},
    n as (select b.symbol, b.timestamp, t.insider_name, sum(coalesce(buy, 0) - coalesce(sell,
        0)) as net from b join t on t.symbol = b.symbol and t.filed_day between b.timestamp::date - 30 and b.timestamp::date and coalesce(buy,
        sell) is not null group by all)
    select symbol, timestamp, count(*) filter (net > 0) as buyers from n group by symbol, timestamp""")
def insider_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many insiders bought on balance over 30 days up to each bar: each trade is laid out on the days it counts for, then two levels of sums."""
    t = trades(spark, sf_dir)
    buy, sell = (F.when(F.col("transaction_type").isin(*kinds), F.col("total_value")) for kinds in (BUYS, SELLS))
    t = t.select("symbol", "filed_day", "insider_name", (F.coalesce(buy, F.lit(0.0)) - F.coalesce(sell, F.lit(0.0))).alias("net"), F.coalesce(buy, sell).alias("any")).where("any is not null")
    daily = t.groupBy("symbol", "filed_day", "insider_name").agg(F.sum("net").alias("net"))
    laid = daily.withColumn("day", F.explode(F.sequence("filed_day", F.date_add("filed_day", 30))))
    per = laid.groupBy("symbol", "day", "insider_name").agg(F.sum("net").alias("net"))
    counts = per.groupBy("symbol", "day").agg(F.count_if(F.col("net") > 0).alias("buyers"))
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp", F.to_date("timestamp").alias("day"))
    return b.join(counts, ["symbol", "day"]).select("symbol", "timestamp", "buyers")


@book.query(f"""with b as ({SOUND_SQL}), t as (select symbol, filed_at as ft, trade_id,
        total_value from ({TRADES_SQL}) qualify row_number() over (partition by symbol, filed_at order by trade_id desc) = 1),
    back as (select b.symbol, b.timestamp, t.ft, t.trade_id from b asof left join t on t.symbol = b.symbol and b.timestamp >= t.ft),
    fwd as (select b.symbol, b.timestamp, t.ft, t.trade_id from b asof left join t on t.symbol = b.symbol and b.timestamp <= t.ft),
    j as (select k.symbol, k.timestamp, k.ft as bt, k.trade_id as bid, f.ft, f.trade_id as fid from back k join fwd f using (symbol, timestamp)),
    p as (select symbol, timestamp, case when bt is not null and (ft is null or timestamp - bt <= ft - timestamp) then bt else ft end as m,
        case when bt is not null and (ft is null or timestamp - bt <= ft - timestamp) then bid else fid end as id from j)
    select symbol, timestamp, case when abs(epoch_us(timestamp) - epoch_us(m)) <= 86400000000 then m end as matched_at,
        case when abs(epoch_us(timestamp) - epoch_us(m)) <= 86400000000 then id end as trade_id from p""")
def nearest_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insider trade nearest to each bar, at most a day away."""
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp")
    return asof_nearest(b, trades(spark, sf_dir).select("symbol", "filed_at", "trade_id"), by=["symbol"], at="timestamp", right_at="filed_at", carry=["trade_id"], tie=["trade_id"], tolerance="1 day")


@book.query(f"""with h as ({HOLDINGS_SQL}), f as (select symbol, period, filer, filed, sum(shares) as x from h group by all),
    e as (select distinct symbol, period, filed from f)
    select e.symbol, e.period::varchar as period, e.filed::varchar as filed, round(sum(x), 4) as total_shares, count(*) as filers from e join lateral (select filer,
        arg_max(x, f.filed) as x from f where f.symbol = e.symbol and f.period = e.period and f.filed <= e.filed group by filer) l on true group by e.symbol,
        e.period, e.filed""")
def ownership_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each filing date the shares and filers of a quarter, each filer by its latest filing: changes summed up, no self-join."""
    f = holdings(spark, sf_dir).groupBy("symbol", "period", "filer", "filed").agg(F.sum("shares").alias("x"))
    w = Window.partitionBy("symbol", "period", "filer").orderBy("filed")
    moved = f.withColumn("dx", F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0.0))).withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(0))
    days = moved.groupBy("symbol", "period", "filed").agg(F.sum("dx").alias("dx"), F.sum("new").alias("new"))
    so_far = Window.partitionBy("symbol", "period").orderBy("filed")
    return days.select("symbol", F.col("period").cast("string").alias("period"), F.col("filed").cast("string").alias("filed"), F.round(F.sum("dx").over(so_far), 4).alias("total_shares"), F.sum("new").over(so_far).alias("filers"))


@book.query(f"""with h as ({HOLDINGS_SQL}), f as (select symbol, period, filer, filed, sum(value) as v from h group by all), l as (select symbol, period, filer,
        arg_max(v, filed) as v from f group by all),
    k as (select *, row_number() over (partition by symbol, period order by v desc, filer) as n from l where v > 0)
    select symbol, period::varchar as period, round(sum(v) filter (n <= 10) / sum(v), 8) as top10_share from k group by symbol, k.period""")
def top10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest filers' share of a quarter's value."""
    f = holdings(spark, sf_dir).groupBy("symbol", "period", "filer", "filed").agg(F.sum("value").alias("v"))
    last = f.groupBy("symbol", "period", "filer").agg(F.max_by("v", "filed").alias("v")).where("v > 0")
    n = F.row_number().over(Window.partitionBy("symbol", "period").orderBy(F.desc("v"), "filer"))
    return last.withColumn("n", n).groupBy("symbol", "period").agg(F.round(F.sum(F.when(F.col("n") <= 10, F.col("v"))) / F.sum("v"), 8).alias("top10_share")).withColumn("period", F.col("period").cast("string"))


_EXPIRY = """x as (select * from (select distinct underlying, quote_date, expiry, dte,
        abs(dte - {t}) as gap from o where dte >= 7 and abs(dte - {t}) <= 21) qualify row_number() over (partition by underlying, quote_date order by gap, dte) = 1)"""


def _near(o: DataFrame, target: int) -> DataFrame:
    choices = o.where((F.col("dte") >= 7) & (F.abs(F.col("dte") - target) <= 21)).select("underlying", "quote_date", "expiry", "dte").distinct()
    best = choices.groupBy("underlying", "quote_date").agg(F.min(F.struct(F.abs(F.col("dte") - target).alias("gap"), "dte", "expiry")).alias("e"))
    return o.join(best.select("underlying", "quote_date", F.col("e.expiry").alias("expiry")), ["underlying", "quote_date", "expiry"], "left_semi")


def _atm_sql(target: int) -> str:
    return f"""with o as ({OPTIONS_SQL}), s as (select underlying, quote_date, avg(price) as spot from o group by all), {_EXPIRY.format(t=target)},
    k as (select underlying, quote_date, strike, avg(iv) as iv from o semi join x using (underlying, quote_date, expiry) where strike > 0 group by all),
    e as (select k.underlying, k.quote_date, any_value(spot) as spot, max(strike) filter (strike <= spot) as lo, min(strike) filter (strike > spot) as hi,
          arg_max(iv, strike) filter (strike <= spot) as ivl, arg_min(iv, strike) filter (strike > spot) as ivh
          from k join s using (underlying, quote_date) group by k.underlying, k.quote_date)
    select underlying, quote_date::varchar as quote_date,
        round(case when lo is null then ivh when hi is null then ivl else ivl + (ivh - ivl) * (ln(spot) - ln(lo)) / (ln(hi) - ln(lo)) end, 8) as atm_iv from e"""


def at_the_money(spark: SparkSession, sf_dir: str, target: int) -> DataFrame:
    """Volatility at the money of the expiry nearest to target days, interpolated in log strike between the strikes around spot."""
    o = options(spark, sf_dir)
    spot = o.groupBy("underlying", "quote_date").agg(F.avg("price").alias("spot"))
    k = _near(o, target).where("strike > 0").groupBy("underlying", "quote_date", "strike").agg(F.avg("iv").alias("iv")).join(spot, ["underlying", "quote_date"])
    below, above = F.when(F.col("strike") <= F.col("spot"), F.col("strike")), F.when(F.col("strike") > F.col("spot"), F.col("strike"))
    e = k.groupBy("underlying", "quote_date").agg(
        F.first("spot").alias("spot"), F.max(below).alias("lo"), F.min(above).alias("hi"), F.max_by("iv", below).alias("ivl"), F.min_by("iv", above).alias("ivh")
    )
    part = (F.ln("spot") - F.ln("lo")) / (F.ln("hi") - F.ln("lo"))
    iv = F.when(F.col("lo").isNull(), F.col("ivh")).when(F.col("hi").isNull(), F.col("ivl")).otherwise(F.col("ivl") + (F.col("ivh") - F.col("ivl")) * part)
    return e.select("underlying", F.col("quote_date").cast("string").alias("quote_date"), F.round(iv, 8).alias("atm_iv"))


@book.query(_atm_sql(30))
def atm_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-the-money volatility of the expiry nearest to 30 days."""
    return at_the_money(spark, sf_dir, 30)


@book.query(f"select underlying, quote_date, round(far.atm_iv - near.atm_iv, 8) as iv_term_slope from ({_atm_sql(60)}) far join ({_atm_sql(30)}) near using (underlying, quote_date)")
def iv_term_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-the-money volatility at 60 days less that at 30, where both expiries are quoted."""
    far, near = at_the_money(spark, sf_dir, 60).withColumnRenamed("atm_iv", "far"), at_the_money(spark, sf_dir, 30)
    return far.join(near, ["underlying", "quote_date"]).select("underlying", "quote_date", F.round(F.col("far") - F.col("atm_iv"), 8).alias("iv_term_slope"))


@book.query(f"""with o as ({OPTIONS_SQL}), {_EXPIRY.format(t=30)},
    n as (select underlying, quote_date, sum(open_interest) filter ("right" = 'P') as puts,
        sum(open_interest) filter ("right" = 'C') as calls from o semi join x using (underlying, quote_date, expiry) group by all),
    g as (select underlying, quote_date, sum(gamma * open_interest * case "right" when 'C' then 1 when 'P' then -1 else 0 end) as gex from o group by all)
    select underlying, quote_date::varchar as quote_date, round(case when calls > 0 then coalesce(puts, 0) / calls end, 8) as put_call_oi_ratio, round(gex,
        6) as net_gamma_exposure from g left join n using (underlying, quote_date)""")
def option_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of put to call interest at the near expiry, and signed gamma exposure of the whole chain."""
    o = options(spark, sf_dir)
    side = F.when(F.col("right") == "C", 1).when(F.col("right") == "P", -1).otherwise(0)
    interest = lambda r: F.sum(F.when(F.col("right") == r, F.col("open_interest")))
    near = _near(o, 30).groupBy("underlying", "quote_date").agg(interest("P").alias("puts"), interest("C").alias("calls"))
    gex = o.groupBy("underlying", "quote_date").agg(F.sum(F.col("gamma") * F.col("open_interest") * side).alias("gex"))
    ratio = F.when(F.col("calls") > 0, F.coalesce("puts", F.lit(0.0)) / F.col("calls"))
    out = gex.join(near, ["underlying", "quote_date"], "left")
    return out.select("underlying", F.col("quote_date").cast("string").alias("quote_date"), F.round(ratio, 8).alias("put_call_oi_ratio"), F.round("gex", 6).alias("net_gamma_exposure"))


QUARTER_DELTA = 0.25


@book.query(f"""with o as ({OPTIONS_SQL}), {_EXPIRY.format(t=30)}, n as (select * from o semi join x using (underlying, quote_date, expiry)),
    k as (select underlying, quote_date, "right", abs_delta as d, avg(iv) as iv from n where abs_delta > 0 and abs_delta <= 1 group by all),
    e as (select underlying, quote_date, "right", min(d) filter (d >= {QUARTER_DELTA}) as hi, max(d) filter (d < {QUARTER_DELTA}) as lo, arg_min(iv,
        d) filter (d >= {QUARTER_DELTA}) as ivh, arg_max(iv, d) filter (d < {QUARTER_DELTA}) as ivl from k group by all),
    i as (select underlying, quote_date, "right", case when lo is null then ivh when hi is null then ivl else ivl + ({QUARTER_DELTA} - lo) / (hi - lo) * (ivh - ivl) end as iv from e)
    select underlying, quote_date::varchar as quote_date, round(max(iv) filter ("right" = 'P') - max(iv) filter ("right" = 'C'),
        8) as skew_25d from i group by underlying, quote_date""")
def skew_25d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of the put less that of the call at a delta of 25, interpolated between the deltas around it; beyond the outermost its own counts."""
    k = _near(options(spark, sf_dir), 30).where("abs_delta > 0 and abs_delta <= 1").groupBy("underlying", "quote_date", "right", F.col("abs_delta").alias("d")).agg(F.avg("iv").alias("iv"))
    above, below = F.when(F.col("d") >= QUARTER_DELTA, F.col("d")), F.when(F.col("d") < QUARTER_DELTA, F.col("d"))
    e = k.groupBy("underlying", "quote_date", "right").agg(F.min(above).alias("hi"), F.max(below).alias("lo"), F.min_by("iv", above).alias("ivh"), F.max_by("iv", below).alias("ivl"))
    between = F.col("ivl") + (QUARTER_DELTA - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("ivh") - F.col("ivl"))
    i = e.withColumn("iv", F.when(F.col("lo").isNull(), F.col("ivh")).when(F.col("hi").isNull(), F.col("ivl")).otherwise(between))
    pick = lambda r: F.max(F.when(F.col("right") == r, F.col("iv")))
    return i.groupBy("underlying", F.col("quote_date").cast("string").alias("quote_date")).agg(F.round(pick("P") - pick("C"), 8).alias("skew_25d"))


@book.query(f"""with b as ({SOUND_SQL}) select symbol, timestamp, round(lead(close, 5) over ({_W}) / close - 1, 8) as fwd_5d, round(lead(close,
        21) over ({_W}) / close - 1, 8) as fwd_21d from b""")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over the next 5 and 21 bars."""
    w = by_symbol()
    return sound_bars(spark, sf_dir).select("symbol", "timestamp", *[F.round(F.lead("close", h).over(w) / F.col("close") - 1, 8).alias(f"fwd_{h}d") for h in (5, 21)])


@book.query(f"""with b as ({SOUND_SQL}), r as (select symbol, timestamp, close / lag(close) over ({_W}) - 1 as r from b), k as (select timestamp,
        r as rb from r where symbol = '{BENCHMARK}'),
    j as (select r.*, rb from r left join k using (timestamp)), c as (select symbol, timestamp, case when r is not null and rb is not null then r end as r,
        case when r is not null and rb is not null then rb end as rb from j)
    select symbol, timestamp, round(case when count(r) over w >= 30 and var_samp(rb) over w > 0 then greatest(least(covar_samp(r, rb) over w / var_samp(rb) over w,
        5), -5) end, 6) as beta_60d
    from c where symbol <> '{BENCHMARK}' window w as ({_W} rows between 59 preceding and current row)""")
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta to the benchmark over 60 bars, from 30 on, clipped to 5; the benchmark has one row per day, so it is sent out only if it is small."""
    w = by_symbol()
    r = sound_bars(spark, sf_dir).select("symbol", "timestamp", simple_return("close", w).alias("r"))
    k = r.where(F.col("symbol") == BENCHMARK).select("timestamp", F.col("r").alias("rb"))
    j = r.where(F.col("symbol") != BENCHMARK).join(k, "timestamp", "left")
    both = F.col("r").isNotNull() & F.col("rb").isNotNull()
    j = j.withColumn("r", F.when(both, F.col("r"))).withColumn("rb", F.when(both, F.col("rb")))
    beta = F.try_divide(rolling(F.covar_samp("r", "rb"), w, 60, "r", 30), rolling(F.var_samp("rb"), w, 60, "rb", 30))
    return j.select("symbol", "timestamp", F.round(F.when(beta.isNotNull(), F.greatest(F.least(beta, F.lit(5.0)), F.lit(-5.0))), 6).alias("beta_60d"))


@book.query(f"""with b as ({SOUND_SQL}), s as (select symbol, timestamp, {_gated('avg(close)', 10, 'close')} as a, {_gated('avg(close)', 30, 'close')} as z from b),
    g as (select *, round(a, 8) > round(z, 8) as long from s where z is not null) select symbol, timestamp,
        round(case when count(*) filter (long) over d > 0 then long::int / (count(*) filter (long) over d)::double else 1.0::double / count(*) over d end,
        10) as weight
    from g window d as (partition by timestamp)""")
def sma_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights of the symbols whose short average is above the long one; of all where none is."""
    w, d = by_symbol(), Window.partitionBy("timestamp")
    s = sound_bars(spark, sf_dir).select("symbol", "timestamp", rolling(F.avg("close"), w, 10, "close").alias("a"), rolling(F.avg("close"), w, 30, "close").alias("z")).where("z is not null")
    s = s.withColumn("long", F.when(F.round("a", 8) > F.round("z", 8), 1).otherwise(0)).withColumn("n", F.sum("long").over(d))
    return s.select("symbol", "timestamp", F.round(F.when(F.col("n") > 0, F.col("long") / F.col("n").cast("double")).otherwise(F.lit(1.0) / F.count("*").over(d)), 10).alias("weight"))
