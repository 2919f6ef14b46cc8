"""Shared inputs of the queries: canonical tables from raw rows, adapter views over the star schema, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import number, symbol
from tidewell.operators.latest import latest
from tidewell.session import table

BENCHMARK = "XBNCHM"
PRICES = ("open", "high", "low", "close")


class Book:
    """The queries of a module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "raw_alpaca_equity_ohlcv")
    return df.select("bar_id", "timestamp", symbol("symbol").alias("symbol"), *[number(c).alias(c) for c in PRICES], F.col("volume").cast("long").alias("volume"), number("vwap").alias("vwap"), F.col("trade_count").cast("long").alias("trade_count"), "ingested_at")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical bars: the newest delivery of each symbol and day."""
    return latest(raw_bars(spark, sf_dir), by=["symbol", "timestamp"], order=["ingested_at", "bar_id"])


def sound_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical bars with a positive close."""
    return bars(spark, sf_dir).where("close > 0")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "raw_fd_financial_metrics")
    numbers = [c for c, t in df.dtypes if t == "double"]
    return df.select("metric_id", "timestamp", symbol("symbol").alias("symbol"), *[number(c).alias(c) for c in numbers], "ingested_at")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider trades, once per delivery key."""
    df = table(spark, sf_dir, "raw_fd_insider_trades").withColumn("symbol", symbol("symbol"))
    df = df.withColumn("filed_day", F.to_date("filed_at")).withColumn("dealt_day", F.to_date("transaction_date"))
    df = df.withColumn("total_value", number("total_value")).withColumn("shares", number("shares"))
    return latest(df, by=["symbol", "insider_name", "transaction_type", "shares", "filed_day", "dealt_day"], order=["ingested_at", "trade_id"])


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of quarterly holdings: star-schema adapter with symbol = brand, filer = customer; seq orders what was delivered."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return joined.select(
        F.col("p_brand").alias("symbol"), F.col("o_custkey").alias("filer"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"), F.to_date("o_orderdate").alias("filed"),
        F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("seq"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly holdings per filer: of several deliveries of a filing the last one counts."""
    return latest(filings(spark, sf_dir), by=["symbol", "filer", "period", "filed"], order=["seq"]).drop("seq")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly option chain: star-schema adapter with underlying = brand."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = li.join(p, li.l_partkey == p.p_partkey)
    quote = F.to_date(F.date_trunc("month", "l_shipdate"))
    days = F.element_at(F.array(*[F.lit(d) for d in (21, 30, 45, 60, 75)]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return joined.select(
        F.col("p_brand").alias("underlying"), quote.alias("quote_date"), F.date_add(quote, days).alias("expiry"), days.alias("dte"), (F.floor(price / 100) * 100.0).alias("strike"),
        F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("right"), (F.lit(0.1) + F.col("l_discount")).alias("iv"), ((1 + F.col("l_quantity")) / 52.0).alias("abs_delta"),
        (F.col("l_tax") / 10.0).alias("gamma"), F.col("l_quantity").alias("open_interest"), price.alias("price"),
    )


_NUM = "case when not isnan({0}) then {0} end as {0}"
RAW_BARS_SQL = "select bar_id, timestamp, upper(trim(symbol)) as symbol, " + ", ".join(_NUM.format(c) for c in PRICES) + ", volume, case when not isnan(vwap) then vwap end as vwap, trade_count, ingested_at from raw_alpaca_equity_ohlcv"
BARS_SQL = f"select * from ({RAW_BARS_SQL}) qualify row_number() over (partition by symbol, timestamp order by ingested_at desc nulls last, bar_id desc) = 1"
SOUND_SQL = f"select * from ({BARS_SQL}) where close > 0"
METRICS_SQL = "select metric_id, timestamp, upper(trim(symbol)) as symbol, ingested_at, " + ", ".join(
    _NUM.format(c) for c in "market_cap pe_ratio ps_ratio pb_ratio ev_ebitda roe roa gross_margin operating_margin net_margin fcf_margin debt_to_equity current_ratio revenue_growth_yoy eps_growth_yoy dividend_yield shares_outstanding".split()
) + " from raw_fd_financial_metrics"
TRADES_SQL = """select * from (select * replace (upper(trim(symbol)) as symbol, case when not isnan(total_value) then total_value end as total_value,
        case when not isnan(shares) then shares end as shares),
    filed_at::date as filed_day, transaction_date::date as dealt_day from raw_fd_insider_trades)
    qualify row_number() over (partition by symbol, insider_name, transaction_type, shares, filed_day, dealt_day order by ingested_at desc nulls last,
        trade_id desc) = 1"""
HOLDINGS_SQL = """select symbol, filer, period, filed, arg_max(shares, seq) as shares, arg_max(value, seq) as value from (
    select p_brand as symbol, o_custkey as filer, date_trunc('quarter', o_orderdate)::date as period, o_orderdate::date as filed, l_quantity as shares,
        l_extendedprice as value,
    (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey,
        l_extendedprice) as seq from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey) group by all"""
OPTIONS_SQL = """select p_brand as underlying, date_trunc('month', l_shipdate)::date as quote_date, date_trunc('month', l_shipdate)::date + ([21, 30, 45, 60,
        75])[l_linenumber % 5 + 1] as expiry, ([21, 30, 45, 60, 75])[l_linenumber % 5 + 1] as dte,
    floor(l_extendedprice / l_quantity / 100) * 100.0::double as strike, case when l_linestatus = 'O' then 'C' else 'P' end as "right",
        0.1::double + l_discount as iv, (1 + l_quantity) / 52.0::double as abs_delta, l_tax / 10.0::double as gamma, l_quantity as open_interest,
        l_extendedprice / l_quantity as price
    from lineitem join part on l_partkey = p_partkey"""


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("timestamp")
