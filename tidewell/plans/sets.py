"""Feature sets: which features belong together, how far they look back, and panels made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import date_range, symbol
from tidewell.plans import books, features
from tidewell.plans.base import BENCHMARK, SOUND_SQL, Book, sound_bars
from tidewell.plans.statistics import returns
from tidewell.session import table
from tidewell.sources.universe import universe_table

book = Book()

#: Bars that each feature looks back on.
LOOKBACKS = {
    "ret_1d": 1, "ret_5d": 5, "ret_21d": 21, "rv_21d": 22, "rv_63d": 64, "dist_20d_high": 20, "dist_20d_low": 20,
    "mom_3m": 63, "mom_12m_excl_1m": 252, "log_mkt_cap": 0, "size_rank": 0, "value_rank": 0,
    "pe_ttm": 0, "ps_ttm": 0, "pb": 0, "ev_ebitda": 0, "roe": 0, "gross_margin": 0, "operating_margin": 0, "fcf_margin": 0, "debt_equity": 0, "eps_growth_1y": 0, "revenue_growth_1y": 0,
    "market_vol_20d": 21, "market_trend_20d": 21, "dispersion_20d": 21, "corr_mean_20d": 21,
    "atm_iv": 0, "skew_25d": 0, "iv_term_slope": 0, "put_call_oi_ratio": 0, "net_gamma_exposure": 0,
    "insider_net_buy_90d": 90, "exec_net_buy_90d": 90, "insider_buy_intensity_30d": 30, "insider_cluster_30d": 30, "inst_ownership_pct": 0, "inst_top10_share": 0,
    "spy_atm_iv": 1, "spy_iv_zscore_60d": 61, "spy_vrp": 21, "spy_iv_term_slope": 1, "spy_skew_zscore_60d": 61, "spy_gex_sign": 1, "spy_gex_norm": 61, "spy_iv_delta_5d": 6, "spy_slope_delta_5d": 6,
}
#: The queries that make each set's features, what they are called there, and the key.
PRICES = ("ret_1d", "ret_5d", "ret_21d", "rv_21d", "rv_63d", "dist_20d_high", "dist_20d_low", "mom_3m", "mom_12m_excl_1m")
RANKS = ("size_rank", "value_rank")
SETS = {"prices": PRICES, "ranks": RANKS, "fundamental": tuple(books.PASSED_ON)}
_MADE = {"prices": features.ohlcv_features, "ranks": features.cross_section, "fundamental": books.fundamental_features}
_SQL = {"prices": features.book.oracles["ohlcv_features"], "ranks": features.book.oracles["cross_section"], "fundamental": books.book.oracles["fundamental_features"]}


def lookback(names: list[str] | tuple[str, ...]) -> int:
    """Bars that the features look back on at most; an error for one that isn't known."""
    unknown = [n for n in names if n not in LOOKBACKS]
    if unknown:
        raise KeyError(f"unknown features: {', '.join(unknown)}")
    return max((LOOKBACKS[n] for n in names), default=0)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all sets one below the other: feature_set, symbol, timestamp and the sets' features, null where a set has none."""
    each = [_MADE[n](spark, sf_dir).select(F.lit(n).alias("feature_set"), "symbol", "timestamp", *SETS[n]) for n in SETS]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def _filled(names: tuple[str, ...]) -> Column:
    return F.greatest(*[F.col(n).isNotNull().cast("int") for n in names])


@book.query(
    " union all ".join(
        f"select '{n}' as feature_set, symbol, count(*) as n, min(timestamp) as first_ts, max(timestamp) as last_ts, date_diff('day', min(timestamp), max(timestamp)) + 1 as span, count(*) filter ({' or '.join(f'{c} is not null' for c in SETS[n])}) as filled from ({_SQL[n]}) group by symbol"
        for n in SETS
    )
)
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, span and rows that hold anything, by feature set and symbol."""
    every = tuple(dict.fromkeys(c for names in SETS.values() for c in names))
    span = (F.datediff(F.max("timestamp"), F.min("timestamp")) + 1).cast("long")
    return feature_rows(spark, sf_dir).groupBy("feature_set", "symbol").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), span.alias("span"), F.sum(_filled(every)).cast("long").alias("filled")
    )


SINCE, UNTIL = "2023-06-01", "2024-06-30"


@book.query(f"""with b as ({SOUND_SQL}), f as ({_SQL['fundamental']}) select f.symbol, f.timestamp, pe_ttm, roe, close from f join b using (symbol,
        timestamp) where f.timestamp >= '{SINCE}' and f.timestamp < date '{UNTIL}' + 1""")
def set_with_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set's rows within a range of days, by name so that sets don't mix, with the close of their bar."""
    rows = feature_rows(spark, sf_dir).where((F.col("feature_set") == "fundamental") & date_range("timestamp", SINCE, UNTIL)).select("symbol", "timestamp", "pe_ttm", "roe")
    return rows.join(sound_bars(spark, sf_dir).select("symbol", "timestamp", "close"), ["symbol", "timestamp"])


@book.query(f"""with b as ({SOUND_SQL}), r as (select symbol, timestamp, close / lag(close) over (partition by symbol order by timestamp) - 1 as ret from b),
        w as ({books.book.oracles['rank_weight_book']}),
    j as (select w.timestamp as wt, r.timestamp as rt, ret is null as bare from w full join (select * from r where ret is not null and symbol <> '{BENCHMARK}') r on r.symbol = w.symbol and r.timestamp = w.timestamp)
    select count(*) filter (wt is not null and rt is not null) as kept, count(*) filter (rt is null) as only_weights,
        count(*) filter (wt is null) as only_returns from j""")
def aligned_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an inner join of weights and returns keeps and drops on either side."""
    w = books.rank_weight_book(spark, sf_dir).select("symbol", "timestamp", F.lit(1).alias("w"))
    r = returns(spark, sf_dir).where(F.col("ret").isNotNull() & (F.col("symbol") != BENCHMARK)).select("symbol", "timestamp", F.lit(1).alias("r"))
    j = w.join(r, ["symbol", "timestamp"], "full_outer")
    return j.agg(F.count_if(F.col("w").isNotNull() & F.col("r").isNotNull()).alias("kept"), F.count_if(F.col("r").isNull()).alias("only_weights"), F.count_if(F.col("w").isNull()).alias("only_returns"))


@book.query(f"""select b.symbol, count(*) as bars, min(b.timestamp) as first_ts from ({SOUND_SQL}) b join (select distinct upper(trim(symbol)) as symbol from raw_fd_insider_trades) u using (symbol)
    where b.timestamp >= '{SINCE}' and b.timestamp < date '{UNTIL}' + 1 group by b.symbol""")
def universe_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a universe of symbols within a range of days; both reach the scan or the join as conditions."""
    u = universe_table(table(spark, sf_dir, "raw_fd_insider_trades").select(symbol("symbol").alias("symbol")))
    return sound_bars(spark, sf_dir).where(date_range("timestamp", SINCE, UNTIL)).join(u, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("bars"), F.min("timestamp").alias("first_ts"))


