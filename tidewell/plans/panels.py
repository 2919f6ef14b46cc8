"""Queries of the point-in-time, dedup, anomaly, rolling and grid operators over the raw vendor tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import date_text, day_number, number, symbol
from tidewell.operators.grid import usable, weekly_grid
from tidewell.operators.known_at import join_known, known_at
from tidewell.operators.rolling import every_day, trailing
from tidewell.operators.spikes import flag_bars
from tidewell.plans.base import Book
from tidewell.session import table

#: A price-earnings ratio of this size or more is a stand-in for a missing value.
NO_PE = 10_000.0
LONGEST_GAP_DAYS = 30
LOOK_BACK_DAYS = 90
CLOSE_SHIFT, VOLUME_SHARE, TRADED = 0.1203, 0.5503, 5_000_000


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_alpaca_equity_ohlcv").withColumn("symbol", symbol("symbol"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_fd_financial_metrics").withColumn("symbol", symbol("symbol"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_fd_fundamentals").withColumn("symbol", symbol("symbol"))


def _known(spark: SparkSession, sf_dir: str, carry_metrics: list[str], carry_statements: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = _bars(spark, sf_dir).select("bar_id", "symbol", "timestamp")
    metrics = _metrics(spark, sf_dir).where(number("shares_outstanding") > 0)
    statements = _statements(spark, sf_dir).where(F.lower(F.trim("period")) == "quarterly")
    statements = statements.where(F.col("ingested_at").isNull() | (F.col("report_date") <= F.col("ingested_at")))
    return (
        bars,
        known_at(bars, metrics, by="symbol", at="timestamp", valid="timestamp", ingested="ingested_at", row_id="metric_id", carry=carry_metrics),
        known_at(bars, statements, by="symbol", at="timestamp", valid="report_date", ingested="ingested_at", row_id="fund_id", carry=carry_statements),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar the metrics row and the quarterly statement known at its time."""
    bars, metrics, statements = _known(spark, sf_dir, [], [])
    both = metrics.select(F.lit("metrics").alias("kind"), "symbol", "timestamp", F.col("metric_id").alias("row_id"))
    both = both.unionByName(statements.select(F.lit("fundamentals").alias("kind"), "symbol", "timestamp", F.col("fund_id").alias("row_id")))
    return join_known(bars, both, by="symbol", at="timestamp", spread="bar_id").select("kind", "row_id", "bar_id")


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with the shares outstanding and the quarterly revenue and earnings known at its time, null where none were."""
    bars, metrics, statements = _known(spark, sf_dir, ["shares_outstanding"], ["revenue", "net_income"])
    keys = ["symbol", "timestamp"]
    known = metrics.join(statements, keys, "full_outer")
    out = join_known(bars, known, by="symbol", at="timestamp", spread="bar_id", how="left")
    return out.select("bar_id", "metric_id", "shares_outstanding", "fund_id", number("revenue").alias("revenue"), number("net_income").alias("net_income"))


def p1_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar the shares outstanding of LOOK_BACK_DAYS before it, as known at the bar: corrections that had arrived by then count."""
    bars = _bars(spark, sf_dir).select("bar_id", "symbol", "timestamp", (F.col("timestamp") - F.expr(f"interval {LOOK_BACK_DAYS} days")).alias("as_of"))
    metrics = _metrics(spark, sf_dir).where(number("shares_outstanding") > 0)
    found = known_at(bars, metrics, by="symbol", at="timestamp", as_of="as_of", valid="timestamp", ingested="ingested_at", row_id="metric_id", carry=["shares_outstanding"])
    return join_known(bars, found, by="symbol", at="timestamp", as_of="as_of", spread="bar_id").select("bar_id", "metric_id", "shares_outstanding")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with an implausible close, high or volume."""
    return p3_flags(spark, sf_dir).where("flagged").select("bar_id")


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with its flags and posterior probabilities."""
    return flag_bars(_bars(spark, sf_dir), row_id="bar_id", source="symbol", at="timestamp", ingested="ingested_at")


def p3_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that break hard bounds or are part of a standing value: what needs no judgement of size."""
    return p3_flags(spark, sf_dir).where("is_impossible or is_stuck").select("bar_id", "is_impossible", "is_stuck")


def daily_bars(bars: DataFrame) -> DataFrame:
    """The newest bar of each symbol and day."""
    newest = F.max(F.struct("timestamp", "ingested_at", "bar_id", F.col("volume").cast("long").alias("volume"), number("close").alias("close")))
    held = bars.where(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull())
    one = held.groupBy("symbol", day_number("timestamp").alias("day")).agg(newest.alias("b"))
    good = F.when(F.col("b.close") > 0, F.col("b.close"))
    volume = F.when(F.col("b.volume") > 0, F.col("b.volume")).otherwise(F.lit(0).cast("long"))
    return one.select("symbol", "day", F.lit(1).cast("long").alias("bars"), volume.alias("volume"), good.alias("close"), F.when(good.isNotNull(), 1).otherwise(0).cast("long").alias("closes"))


def daily_trades(trades: DataFrame) -> DataFrame:
    """Total value of each symbol and day, repeated deliveries counted once."""
    value = F.coalesce(number("total_value"), F.lit(0.0))
    held = trades.withColumn("symbol", symbol("symbol")).where("symbol is not null and filed_at is not null")
    newest = F.max(F.struct("ingested_at", "trade_id", value.alias("value"))).alias("b")
    keys = ["symbol", "insider_name", "transaction_type", "shares", day_number("filed_at").alias("day"), day_number("transaction_date").alias("dealt")]
    once = held.groupBy(*keys).agg(newest)
    return once.groupBy("symbol", "day").agg(F.sum("b.value").alias("total_value"))


def rolling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["bars", "volume", "close", "closes"]
    dense = every_day(daily_bars(_bars(spark, sf_dir)), by=["symbol"], day="day", values=values, longest_gap=LONGEST_GAP_DAYS)
    return trailing(dense, by=["symbol"], day="day", values=values, days=[7, 30])


def rolling_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = every_day(daily_trades(table(spark, sf_dir, "raw_fd_insider_trades")), by=["symbol"], day="day", values=["total_value"])
    return trailing(dense, by=["symbol"], day="day", values=["total_value"], days=[7, 30])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose 7-day total or average stands out from that of 30 days."""
    b = rolling_bars(spark, sf_dir).where("bars_30 >= 8")
    burst = (F.col("volume_30") > 0) & (F.col("volume_7") >= F.lit(VOLUME_SHARE) * F.col("volume_30"))
    short, long_ = F.try_divide("close_7", "closes_7"), F.try_divide("close_30", "closes_30")
    moved = F.abs(short - long_) >= F.lit(CLOSE_SHIFT) * long_
    case = lambda df, name, cond: df.where(cond).select(F.lit(name).alias("measure_name"), "symbol", date_text(F.col("day")).alias("day_date"))
    both = F.filter(F.array(F.when(burst, "volume"), F.when(moved, "close")), lambda x: x.isNotNull())
    bars = b.select(F.explode(both).alias("measure_name"), "symbol", date_text(F.col("day")).alias("day_date"))
    trades = case(rolling_trades(spark, sf_dir), "total_value", (F.col("total_value_7") == 0) & (F.col("total_value_30") >= TRADED))
    return bars.unionByName(trades)


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 7-day and 30-day totals and averages for every symbol and calendar day."""
    avg = lambda total, n: F.round(F.try_divide(total, n), 6)
    b = rolling_bars(spark, sf_dir).select(
        F.lit("bars").alias("kind"), "symbol", date_text(F.col("day")).alias("day_date"), F.col("volume_7").cast("double").alias("total_7"), F.col("volume_30").cast("double").alias("total_30"),
        avg("close_7", "closes_7").alias("average_7"), avg("close_30", "closes_30").alias("average_30"),
    )
    t = rolling_trades(spark, sf_dir).select(
        F.lit("trades").alias("kind"), "symbol", date_text(F.col("day")).alias("day_date"), F.round("total_value_7", 2).alias("total_7"), F.round("total_value_30", 2).alias("total_30"),
        F.round(F.col("total_value_7") / 7, 6).alias("average_7"), F.round(F.col("total_value_30") / 30, 6).alias("average_30"),
    )
    return b.unionByName(t)


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly market_cap and pe_ratio of each symbol with filled weeks marked, and runs whose filling didn't settle."""
    m = _metrics(spark, sf_dir)
    each = F.explode(F.array(
        F.struct(F.lit("market_cap").alias("field_name"), usable(F.col("market_cap"), at_least=0.0).alias("value")),
        F.struct(F.lit("pe_ratio").alias("field_name"), usable(F.col("pe_ratio"), below_size=NO_PE, but=0.0).alias("value")),
    ))
    readings = m.select("symbol", "timestamp", each.alias("e")).select("symbol", "timestamp", "e.field_name", "e.value")
    grid = weekly_grid(readings, by=["field_name", "symbol"], at="timestamp", value="value", longest_gap="56 days")
    return grid.select("field_name", "symbol", "run", date_text(F.col("week") * 7 - 3).alias("week_start"), "value", "readings", "filled", "converged")


def p5_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks of the grid that hold readings, with their mean and number."""
    read = p5_grid(spark, sf_dir).where("not filled")
    return read.select("field_name", "symbol", "run", "week_start", F.when(F.col("field_name") == "market_cap", F.round("value", 1)).otherwise(F.round("value", 6)).alias("value"), "readings")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks within a run that hold no usable reading."""
    return p5_grid(spark, sf_dir).where("filled").select("field_name", "symbol", "week_start")


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p1_before, p3_found, p3_flags, p3_certain, p4_found, p4_totals, p5_found, p5_grid, p5_readings)}

_SYMBOL = "upper(trim(symbol))"
def _known_sql(metrics: str, statements: str) -> str:
    return f"""
    with b as (select distinct {_SYMBOL} as symbol, timestamp as t from raw_alpaca_equity_ohlcv where symbol is not null and timestamp is not null),
    m as (select {_SYMBOL} as symbol, timestamp as valid, ingested_at as ing, metric_id as id, shares_outstanding from raw_fd_financial_metrics
          where shares_outstanding > 0 and not isnan(shares_outstanding) and timestamp is not null),
    f as (select {_SYMBOL} as symbol, report_date as valid, ingested_at as ing, fund_id as id, revenue, net_income from raw_fd_fundamentals
          where lower(trim(period)) = 'quarterly' and report_date is not null and (ingested_at is null or report_date <= ingested_at)),
    km as (select b.symbol, b.t, {metrics} from b join m on m.symbol = b.symbol and m.valid <= b.t and (m.ing is null or m.ing <= b.t)
           qualify row_number() over (partition by b.symbol, b.t order by m.valid desc, m.ing desc nulls last, m.id desc) = 1),
    kf as (select b.symbol, b.t, {statements} from b join f on f.symbol = b.symbol and f.valid <= b.t and (f.ing is null or f.ing <= b.t)
           qualify row_number() over (partition by b.symbol, b.t order by f.valid desc, f.ing desc nulls last, f.id desc) = 1)
    """


_DAILY_SQL = f"""
    with newest as (select {_SYMBOL} as symbol, timestamp::date as d, volume, close from raw_alpaca_equity_ohlcv where symbol is not null and timestamp is not null
        qualify row_number() over (partition by {_SYMBOL}, timestamp::date order by timestamp desc, ingested_at desc nulls last, bar_id desc) = 1),
    bars as (select symbol, d, greatest(coalesce(volume, 0), 0) as volume, case when close > 0 and not isnan(close) then close end as close from newest),
    marked as (select *, case when d - lag(d) over (partition by symbol order by d) > {LONGEST_GAP_DAYS} then 1 else 0 end as brk from bars),
    runs as (select *, sum(brk) over (partition by symbol order by d) as run from marked),
    spans as (select symbol, run, min(d) as a, max(d) as z from runs group by all),
    days as (select symbol, run, unnest(generate_series(a, z, interval 1 day))::date as d from spans),
    dense as (select y.symbol, y.run, y.d, r.volume, r.close, r.d is not null as has from days y left join runs r on r.symbol = y.symbol and r.d = y.d),
    w as (select symbol, d,
        sum(coalesce(volume, 0)) over w7 as v7, sum(coalesce(volume, 0)) over w30 as v30, avg(close) over w7 as c7, avg(close) over w30 as c30,
        sum(has::int) over w30 as n30 from dense
        window w7 as (partition by symbol, run order by d rows between 6 preceding and current row), w30 as (partition by symbol,
        run order by d rows between 29 preceding and current row)),
    trades as (select {_SYMBOL} as symbol, filed_at::date as d,
        case when total_value is null or isnan(total_value) then 0 else total_value end as v from raw_fd_insider_trades
        where symbol is not null and filed_at is not null
        qualify row_number() over (partition by {_SYMBOL}, insider_name, transaction_type, shares, filed_at::date,
        transaction_date::date order by ingested_at desc nulls last, trade_id desc) = 1),
    traded as (select symbol, d, sum(v) as v from trades group by all),
    tdays as (select symbol, unnest(generate_series(min(d), max(d), interval 1 day))::date as d from traded group by symbol),
    tw as (select y.symbol, y.d, sum(coalesce(t.v, 0)) over a as t7, sum(coalesce(t.v,
        0)) over b as t30 from tdays y left join traded t on t.symbol = y.symbol and t.d = y.d
        window a as (partition by y.symbol order by y.d rows between 6 preceding and current row),
        b as (partition by y.symbol order by y.d rows between 29 preceding and current row))
    """

_USABLE = {"market_cap": "market_cap > 0", "pe_ratio": f"pe_ratio <> 0 and abs(pe_ratio) < {NO_PE}"}
_WEEKS = " union all ".join(
    f"select '{n}' as field_name, {_SYMBOL} as symbol, timestamp as t from raw_fd_financial_metrics where {n} is not null and not isnan({n}) and not isinf({n}) and {ok} and symbol is not null and timestamp is not null"
    for n, ok in _USABLE.items()
)

_WEEK_VALUES = " union all ".join(
    f"select '{n}' as field_name, {_SYMBOL} as symbol, timestamp as t, {n} as v from raw_fd_financial_metrics where {n} is not null and not isnan({n}) and not isinf({n}) and {ok} and symbol is not null and timestamp is not null"
    for n, ok in _USABLE.items()
)

ORACLES = {
    "p1_found": _known_sql("m.id as row_id", "f.id as row_id") + f"""
    select 'metrics' as kind, km.row_id, r.bar_id from raw_alpaca_equity_ohlcv r join km on km.symbol = upper(trim(r.symbol)) and km.t = r.timestamp
    union all select 'fundamentals', kf.row_id, r.bar_id from raw_alpaca_equity_ohlcv r join kf on kf.symbol = upper(trim(r.symbol)) and kf.t = r.timestamp""",
    "p1_attributes": _known_sql("m.id as metric_id, m.shares_outstanding", "f.id as fund_id, f.revenue, f.net_income") + """
    select r.bar_id, km.metric_id, km.shares_outstanding, kf.fund_id, case when not isnan(kf.revenue) then kf.revenue end as revenue,
        case when not isnan(kf.net_income) then kf.net_income end as net_income
    from raw_alpaca_equity_ohlcv r left join km on km.symbol = upper(trim(r.symbol)) and km.t = r.timestamp left join kf on kf.symbol = upper(trim(r.symbol)) and kf.t = r.timestamp""",
    "p1_before": f"""
    with b as (select bar_id, {_SYMBOL} as symbol, timestamp as t, timestamp - interval {LOOK_BACK_DAYS} days as v from raw_alpaca_equity_ohlcv),
    m as (select {_SYMBOL} as symbol, timestamp as valid, ingested_at as ing, metric_id,
        shares_outstanding from raw_fd_financial_metrics where shares_outstanding > 0 and not isnan(shares_outstanding))
    select bar_id, metric_id, shares_outstanding from b join m on m.symbol = b.symbol and m.valid <= b.v and (m.ing is null or m.ing <= b.t)
    qualify row_number() over (partition by bar_id order by m.valid desc, m.ing desc nulls last, m.metric_id desc) = 1""",
    "p3_certain": f"""
    with r as (select bar_id, {_SYMBOL} as symbol, timestamp::date as d,
        {', '.join(f'case when not isnan({c}) then {c} end as {c}' for c in ('open', 'high', 'low', 'close'))}, volume from raw_alpaca_equity_ohlcv),
    k as (select *, coalesce(open <= 0 or high <= 0 or low <= 0 or close <= 0, false) or coalesce(volume < 0, false) or coalesce(high < low,
        false) or coalesce(high < open, false) or coalesce(high < close, false)
          or coalesce(open <= 0, false) or coalesce(high <= 0, false) or coalesce(low <= 0, false) or coalesce(close <= 0, false) as is_impossible from r),
    days as (select symbol, d, row_number() over (partition by symbol order by d) as n from (select distinct symbol, d from r where symbol is not null)),
    held as (select distinct symbol, d, open, high, low, close, n from r join days using (symbol,
        d) where open is not null and high is not null and low is not null and close is not null),
    g as (select *, n - row_number() over (partition by symbol, open, high, low, close order by n) as island from held),
    runs as (select symbol, d, open, high, low, close, count(*) over (partition by symbol, open, high, low, close, island) as days from g)
    select bar_id, is_impossible, coalesce(days >= 6, false) and not is_impossible as is_stuck from k left join runs using (symbol, d, open, high, low,
        close) where is_impossible or days >= 6""",
    "p4_found": _DAILY_SQL + f"""
    select 'volume' as measure_name, symbol, strftime(d, '%Y-%m-%d') as day_date from w where n30 >= 8 and v30 > 0 and v7 >= {VOLUME_SHARE}::double * v30
    union all select 'close', symbol, strftime(d, '%Y-%m-%d') from w where n30 >= 8 and abs(c7 - c30) >= {CLOSE_SHIFT}::double * c30
    union all select 'total_value', symbol, strftime(d, '%Y-%m-%d') from tw where t7 = 0 and t30 >= {TRADED}""",
    "p4_totals": _DAILY_SQL + """
    select 'bars' as kind, symbol, strftime(d, '%Y-%m-%d') as day_date, v7::double as total_7, v30::double as total_30, round(c7, 6) as average_7, round(c30,
        6) as average_30 from w
    union all select 'trades', symbol, strftime(d, '%Y-%m-%d'), round(t7, 2), round(t30, 2), round(t7 / 7, 6), round(t30 / 30, 6) from tw""",
    "p5_readings": f"""
    with r as ({_WEEK_VALUES}),
    m as (select *, case when t > lag(t) over (partition by field_name, symbol order by t) + interval 56 days then 1 else 0 end as brk from r),
    n as (select *, sum(brk) over (partition by field_name, symbol order by t) as run from m)
    select field_name, symbol, run, strftime(date_trunc('week', t), '%Y-%m-%d') as week_start, case when field_name = 'market_cap' then round(avg(v), 1) else round(avg(v), 6) end as value,
        count(*) as readings from n group by field_name, symbol, run, date_trunc('week', t)""",
    "p5_found": f"""
    with r as ({_WEEKS}),
    m as (select *, case when t > lag(t) over (partition by field_name, symbol order by t) + interval 56 days then 1 else 0 end as brk from r),
    n as (select *, sum(brk) over (partition by field_name, symbol order by t) as run from m),
    s as (select field_name, symbol, run, min(date_trunc('week', t)) as a, max(date_trunc('week', t)) as z from n group by all),
    g as (select field_name, symbol, run, unnest(generate_series(a, z, interval 7 days)) as wk from s)
    select field_name, symbol, strftime(wk, '%Y-%m-%d') as week_start from g
    where not exists (select 1 from n where n.field_name = g.field_name and n.symbol = g.symbol and date_trunc('week', n.t) = g.wk)""",
}

book = Book()
book.queries, book.oracles = QUERIES, ORACLES
