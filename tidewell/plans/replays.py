"""Books replayed over days: value, costs, execution within a day's prices, rewards and modes; and marks of shared series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.series import simple_return
from tidewell.plans.base import BENCHMARK, METRICS_SQL, SOUND_SQL, Book, by_symbol, metrics, sound_bars
from tidewell.plans.features import _MARKET_SQL, market
from tidewell.session import table

book = Book()
_W = "partition by symbol order by timestamp"
#: Cost and slippage in parts of what is traded, the chance that an order is filled, and what a reward takes for turnover and drawdown.
COST, SLIP, FILLED, TURNOVER_SCALE, DRAWDOWN_SCALE = 0.0005, 0.0005, 0.9, 0.1, 0.5
HELD = 5

_BOOK_SQL = f"""b as ({SOUND_SQL}), f as (select symbol, timestamp, open, high, low, close, volume, close / lag(close, 21) over ({_W}) - 1 as mom,
        coalesce(lead(close) over ({_W}) / close - 1, 0) as fwd from b),
    k as (select *, row_number() over (partition by timestamp order by mom desc, symbol) as n from f where mom is not null and symbol <> '{BENCHMARK}'),
        w as (select *, case when n <= {HELD} then 0.2::double else 0.0::double end as w from k)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights in the strongest symbols of each day, with the day's prices and the return to the next bar."""
    w = by_symbol()
    f = sound_bars(spark, sf_dir).select(
        "symbol", "timestamp", "open", "high", "low", "close", "volume", simple_return("close", w, 21).alias("mom"), F.coalesce(F.lead("close").over(w) / F.col("close") - 1, F.lit(0.0)).alias("fwd")
    )
    n = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("mom"), "symbol"))
    return f.where(F.col("mom").isNotNull() & (F.col("symbol") != BENCHMARK)).withColumn("w", F.when(n <= HELD, 0.2).otherwise(0.0)).drop("mom")


_PATH_SQL = f"""{_BOOK_SQL}, p as (select *, coalesce(lag(w) over ({_W}), 0) as pw from w), d as (select timestamp, sum(w * fwd) as ret,
        sum(abs(w - pw)) as traded from p group by timestamp),
    v as (select timestamp, ret, traded, traded * {COST}::double as cost, ln(1 + ret) + ln(1 - traded * {COST}::double) as reward from d), c as (select *,
        exp(sum(reward) over (order by timestamp)) as value from v),
    t as (select *, greatest(max(value) over (order by timestamp), 1.0) as peak from c), u as (select *, (peak - value) / peak as down from t)"""


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's value day by day: returns less costs of trading, added up as logs; one row per day is all that is ordered."""
    p = weights(spark, sf_dir).withColumn("pw", F.coalesce(F.lag("w").over(by_symbol()), F.lit(0.0)))
    d = p.groupBy("timestamp").agg(F.sum(F.col("w") * F.col("fwd")).alias("ret"), F.sum(F.abs(F.col("w") - F.col("pw"))).alias("traded"))
    days = Window.partitionBy(F.lit(0)).orderBy("timestamp")
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    v = d.withColumn("cost", F.col("traded") * COST).withColumn("reward", F.ln(1 + F.col("ret")) + F.ln(1 - F.col("cost")))
    c = v.withColumn("value", F.exp(F.sum("reward").over(so_far)))
    return c.withColumn("peak", F.greatest(F.max("value").over(so_far), F.lit(1.0))).withColumn("down", (F.col("peak") - F.col("value")) / F.col("peak"))


@book.query(f"""with {_PATH_SQL} select timestamp, round(ln(value), 8) as log_value, round(ret, 8) as ret, round(traded, 8) as traded, round(cost, 10) as cost,
        round(down, 7) as drawdown from u""")
def replayed_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book replayed from its weights: value, return, what was traded, its cost and the fall from the peak."""
    return path(spark, sf_dir).select("timestamp", F.round(F.ln("value"), 8).alias("log_value"), *[F.round(c, k).alias(n) for c, n, k in (("ret", "ret", 8), ("traded", "traded", 8), ("cost", "cost", 10), ("down", "drawdown", 7))])


@book.query(f"""with {_PATH_SQL}, r as (select *, greatest(0, down - coalesce(lag(down) over (order by timestamp), 0)) as fell from u)
    select timestamp, round(reward, 8) as base, round(0.5 * traded * {TURNOVER_SCALE}, 8) as turnover_penalty, round(fell * {DRAWDOWN_SCALE}, 7) as drawdown_penalty,
    round(greatest(-1.0, least(1.0, reward - 0.5 * traded * {TURNOVER_SCALE} - fell * {DRAWDOWN_SCALE})), 7) as final from r""")
def shaped_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's log gain and what is taken from it for turnover and for a deeper drawdown."""
    fell = F.greatest(F.lit(0.0), F.col("down") - F.coalesce(F.lag("down").over(Window.partitionBy(F.lit(0)).orderBy("timestamp")), F.lit(0.0)))
    r = path(spark, sf_dir).withColumn("turnover_penalty", 0.5 * F.col("traded") * TURNOVER_SCALE).withColumn("drawdown_penalty", fell * DRAWDOWN_SCALE)
    final = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("reward") - F.col("turnover_penalty") - F.col("drawdown_penalty")))
    return r.select("timestamp", F.round("reward", 8).alias("base"), F.round("turnover_penalty", 8).alias("turnover_penalty"), F.round("drawdown_penalty", 7).alias("drawdown_penalty"), F.round(final, 7).alias("final"))


def draw(*columns: Column) -> Column:
    """A number from 0 to 1 (without 1) that depends on the columns' texts alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


@book.query(f"""with {_BOOK_SQL}, q as (select *, ('0x' || substr(md5(symbol || '|' || strftime(timestamp, '%Y-%m-%d')), 1,
        8))::bigint / 4294967296.0::double > {FILLED} as missed from w),
    r as (select *, coalesce(last_value(case when not missed then w end ignore nulls) over ({_W}), 0) as realized from q), p as (select *,
        coalesce(lag(realized) over ({_W}), 0) as pw from r),
    e as (select *, abs(w - pw) >= 1e-10 as trades, abs(w - pw) as moved, {SLIP}::double * case when volume > 0 then least(1e6 / volume,
        5) else 5 end as slip from p)
    select timestamp, count(*) filter (trades) as orders, count(*) filter (trades and w > pw) as buys, count(*) filter (trades and missed) as missed,
        round(coalesce(sum(moved) filter (trades and missed), 0), 8) as unfilled,
    round(coalesce(sum(moved * slip) filter (trades and not missed) / nullif(sum(moved) filter (trades and not missed), 0), 0) * 10000, 5) as slippage_bps,
        round(sum(realized), 8) as invested from e group by timestamp""")
def executed_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book whose orders are missed now and then, by a draw from symbol and day: a missed one leaves the weight that was last reached. Slippage grows as volume thins."""
    w = by_symbol()
    q = weights(spark, sf_dir).withColumn("missed", draw(F.col("symbol"), F.date_format("timestamp", "yyyy-MM-dd")) > FILLED)
    reached = F.last(F.when(~F.col("missed"), F.col("w")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = q.withColumn("realized", F.coalesce(reached, F.lit(0.0))).withColumn("pw", F.coalesce(F.lag("realized").over(w), F.lit(0.0)))
    moved = F.abs(F.col("w") - F.col("pw"))
    slip = SLIP * F.when(F.col("volume") > 0, F.least(F.try_divide(F.lit(1e6), F.col("volume").cast("double")), F.lit(5.0))).otherwise(F.lit(5.0))
    e = r.select("timestamp", "w", "pw", "missed", "realized", (moved >= 1e-10).alias("trades"), moved.alias("moved"), slip.alias("slip"))
    filled = F.when(F.col("trades") & ~F.col("missed"), F.col("moved"))
    lost = F.when(F.col("trades") & F.col("missed"), F.col("moved"))
    bps = F.coalesce(F.try_divide(F.sum(filled * F.col("slip")), F.sum(filled)), F.lit(0.0)) * 10000
    return e.groupBy("timestamp").agg(
        F.count_if("trades").alias("orders"), F.count_if(F.col("trades") & (F.col("w") > F.col("pw"))).alias("buys"), F.count_if(F.col("trades") & F.col("missed")).alias("missed"),
        F.round(F.coalesce(F.sum(lost), F.lit(0.0)), 8).alias("unfilled"), F.round(bps, 5).alias("slippage_bps"), F.round(F.sum("realized"), 8).alias("invested"),
    )


#: A mode is looked at again every so many days and kept at least so long; above these levels the market is wild, or rises apart.
LOOK_EVERY, HOLD_DAYS, WILD, RISING, APART = 5, 10, 0.25, 0.02, 0.02


@book.query(f"""with recursive {_MARKET_SQL}, n as (select timestamp, row_number() over (order by timestamp) as i,
        case when coalesce(round(market_vol_20d, 8), 0) >= {WILD} then 'defensive' when coalesce(round(market_trend_20d, 8),
        0) >= {RISING} and coalesce(round(dispersion_20d, 8), 0) >= {APART} then 'risk_on' else 'neutral' end as wanted from m),
    s as (select 0::bigint as i, 'neutral' as mode, 0::bigint as since union all
        select n.i, case when n.i % {LOOK_EVERY} = 0 and s.since + 1 >= {HOLD_DAYS} then n.wanted else s.mode end,
        case when n.i % {LOOK_EVERY} = 0 and s.since + 1 >= {HOLD_DAYS} and n.wanted <> s.mode then 0 else s.since + 1 end from s join n on n.i = s.i + 1)
    select n.timestamp, n.wanted, s.mode from n join s on s.i = n.i""")
def market_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode that the market asks for each day, and the one in force when it is looked at only now and then and kept for a while: an ordered fold over days."""
    at = lambda c: F.coalesce(F.round(c, 8), F.lit(0.0))
    wanted = F.when(at("market_vol_20d") >= WILD, "defensive").when((at("market_trend_20d") >= RISING) & (at("dispersion_20d") >= APART), "risk_on").otherwise("neutral")
    days = market(spark, sf_dir).select("timestamp", wanted.alias("wanted"))
    listed = days.groupBy().agg(F.sort_array(F.collect_list(F.struct("timestamp", "wanted"))).alias("days"))
    one = "struct<timestamp:timestamp,wanted:string,mode:string>"
    start = F.struct(F.lit(0).alias("i"), F.lit("neutral").alias("mode"), F.lit(0).alias("since"), F.array().cast(f"array<{one}>").alias("done"))

    def step(s: Column, d: Column) -> Column:
        i = s.i + 1
        free = (i % LOOK_EVERY == 0) & (s.since + 1 >= HOLD_DAYS)
        mode = F.when(free, d.wanted).otherwise(s["mode"])
        since = F.when(free & (d.wanted != s["mode"]), F.lit(0)).otherwise(s.since + 1)
        made = F.struct(d.timestamp.alias("timestamp"), d.wanted.alias("wanted"), mode.alias("mode"))
        return F.struct(i.alias("i"), mode.alias("mode"), since.alias("since"), F.concat(s.done, F.array(made)).alias("done"))

    folded = listed.select(F.aggregate("days", start, step).getField("done").alias("done"))
    return folded.select(F.explode("done").alias("d")).select("d.timestamp", "d.wanted", "d.mode")


@book.query(f"""with {_MARKET_SQL}, k as ({METRICS_SQL})
    select '__universe__' as series, least(max(b.timestamp), (select max(timestamp) from k)) as watermark from b union all select '__regime__',
        (select max(timestamp) from m)""")
def series_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water marks of what all symbols share: the cross-section, no later than the metrics it ranks by, and the market's series."""
    bars, known = sound_bars(spark, sf_dir).agg(F.max("timestamp").alias("at")), metrics(spark, sf_dir).agg(F.max("timestamp").alias("at"))
    universe = bars.unionByName(known).agg(F.min("at").alias("watermark")).select(F.lit("__universe__").alias("series"), "watermark")
    regime = market(spark, sf_dir).agg(F.max("timestamp").alias("watermark")).select(F.lit("__regime__").alias("series"), "watermark")
    return universe.unionByName(regime)


CATALOGUED = ("raw_alpaca_equity_ohlcv", "raw_fd_fundamentals", "raw_fd_financial_metrics", "raw_fd_insider_trades", "documents", "orders", "lineitem", "events")


@book.query(" union all ".join(f"select '{t}' as name, (select count(*) from information_schema.columns where table_name = '{t}') as columns, count(*) as rows from {t}" for t in CATALOGUED))
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rows of each table; rows come from the files' footers."""
    out = None
    for name in CATALOGUED:
        t = table(spark, sf_dir, name)
        one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(len(t.columns)).cast("long").alias("columns"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
