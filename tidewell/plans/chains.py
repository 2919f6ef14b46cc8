"""Option chains, filings per filer and the features made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.latest import latest, preserving
from tidewell.operators.series import rolling
from tidewell.plans import features
from tidewell.plans.base import HOLDINGS_SQL, OPTIONS_SQL, Book, filings, options
from tidewell.session import table

book = Book()
CONTRACT = ["underlying", "quote_date", "expiry", "strike", "right"]
GREEKS = ["iv", "gamma", "open_interest"]
#: A volatility above this can't be.
MOST_IV = 20.0
#: Spellings of an option's right.
CALLS, PUTS = ("C", "CALL", "CALLS"), ("P", "PUT", "PUTS")
_SPELLED = (*CALLS, *PUTS)

_DELIVERIES_SQL = f"""select p_brand as underlying, date_trunc('quarter', l_shipdate)::date as quote_date,
    date_trunc('quarter', l_shipdate)::date + ([21, 60])[l_linenumber % 2 + 1] as expiry,
        case when l_quantity <> 48 then floor(l_extendedprice / l_quantity / 500) * 500.0::double end as strike,
    ({list(_SPELLED)})[(case when l_linestatus = 'O' then 0 else 3 end) + l_suppkey % 3 + 1] as "right", l_extendedprice / l_quantity as price,
    case when l_quantity = 50 then 60.0::double when l_tax >= 0.02 then 0.1::double + l_discount end as iv,
        case when l_tax >= 0.01 then l_tax / 10.0::double end as gamma,
    case when l_quantity = 49 then -1.0::double when l_discount > 0 then l_quantity end as open_interest, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey,
        l_extendedprice) as seq
    from lineitem join part on l_partkey = p_partkey"""
_RIGHT_SQL = f"""case when "right" in {CALLS} then 'C' when "right" in {PUTS} then 'P' else "right" end"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered option rows, with repeats, spellings, gaps and impossible values: a star-schema adapter."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    quote = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    days = F.when(F.col("l_linenumber") % 2 == 0, 21).otherwise(60)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    spelled = F.element_at(F.array(*[F.lit(x) for x in _SPELLED]), (F.when(F.col("l_linestatus") == "O", 0).otherwise(3) + F.col("l_suppkey") % 3 + 1).cast("int"))
    is_ = lambda n: F.col("l_quantity") == n
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("underlying"), quote.alias("quote_date"), F.date_add(quote, days).alias("expiry"), F.when(~is_(48), F.floor(price / 500) * 500.0).alias("strike"), spelled.alias("right"), price.alias("price"),
        F.when(is_(50), 60.0).when(F.col("l_tax") >= 0.02, 0.1 + F.col("l_discount")).alias("iv"), F.when(F.col("l_tax") >= 0.01, F.col("l_tax") / 10.0).alias("gamma"),
        F.when(is_(49), -1.0).when(F.col("l_discount") > 0, F.col("l_quantity")).alias("open_interest"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("seq"),
    )


def right(c: str) -> Column:
    """C or P, however an option's right is spelled; anything else as it is."""
    return F.when(F.col(c).isin(*CALLS), "C").when(F.col(c).isin(*PUTS), "P").otherwise(F.col(c))


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("quote_date", F.col("quote_date").cast("string")).withColumn("expiry", F.col("expiry").cast("string"))


@book.query(f"""select underlying, quote_date::varchar as quote_date, expiry::varchar as expiry, strike, {_RIGHT_SQL} as "right", arg_max(price, seq) as price,
    {', '.join(f'arg_max({g}, seq) filter ({g} is not null) as {g}' for g in GREEKS)} from ({_DELIVERIES_SQL}) group by underlying, quote_date, expiry, strike,
        {_RIGHT_SQL}""")
def option_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each contract and day, its missing greeks taken from the last one that has them; spellings of the right are one."""
    d = deliveries(spark, sf_dir).withColumn("right", right("right"))
    return _texts(preserving(d, by=CONTRACT, order=["seq"], keep=GREEKS).drop("seq"))


_SNAPSHOT_SQL = f"""select underlying, quote_date, expiry, strike, "right", arg_max(iv, seq) as iv, arg_max(open_interest, seq) as open_interest, arg_max(gamma,
        seq) filter (gamma is not null) as gamma from (
    select * replace (coalesce(strike, 'nan'::double) as strike, coalesce(iv, 'nan'::double) as iv, coalesce(open_interest,
        'nan'::double) as open_interest) from ({_DELIVERIES_SQL})) group by all"""


@book.query(f"""select underlying, case when isnan(strike) then 'missing_strike' when open_interest < 0 and not isnan(open_interest) then 'negative_open_interest' when not isnan(iv) and iv < 0 then 'negative_iv'
    when not isnan(iv) and iv > {MOST_IV} then 'iv_too_high' else 'kept' end as verdict, count(*) as contracts,
        count(gamma) as with_gamma from ({_SNAPSHOT_SQL}) group by all""")
def option_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot chains by contract as spelled, only the gamma kept from earlier deliveries, and how many of each underlying are refused and why."""
    whole = lambda c: F.coalesce(c, F.lit(float("nan")))
    d = deliveries(spark, sf_dir).withColumns({c: whole(c) for c in ("strike", "iv", "open_interest")})
    last = preserving(d.drop("price"), by=CONTRACT, order=["seq"], keep=["gamma"])
    told = lambda c: ~F.isnan(c)
    verdict = (
        F.when(F.isnan("strike"), "missing_strike").when(told("open_interest") & (F.col("open_interest") < 0), "negative_open_interest").when(told("iv") & (F.col("iv") < 0), "negative_iv")
        .when(told("iv") & (F.col("iv") > MOST_IV), "iv_too_high").otherwise("kept")
    )
    return last.groupBy("underlying", verdict.alias("verdict")).agg(F.count("*").alias("contracts"), F.count("gamma").alias("with_gamma"))


@book.query(f"select symbol, filer, period::varchar as period, filed::varchar as filed, shares, value from ({HOLDINGS_SQL})")
def filer_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per filer, quarter and filing day: the last one delivered."""
    one = latest(filings(spark, sf_dir), by=["symbol", "filer", "period", "filed"], order=["seq"])
    return one.select("symbol", "filer", F.col("period").cast("string").alias("period"), F.col("filed").cast("string").alias("filed"), "shares", "value")


_OUTSTANDING_SQL = "select p_brand as symbol, sum(p_size) * 100.0::double as outstanding from part group by all"


@book.query(f"""with e as ({features.book.oracles['ownership_evolution']}), o as ({_OUTSTANDING_SQL}),
    b as (select symbol, filed, max((period, filed, total_shares)) over (partition by symbol order by filed) as best from e),
    k as (select symbol, filed, max(best) as best from b group by all)
    select symbol, filed, best[1] as period, round(best[3] / nullif(outstanding, 0), 8) as inst_ownership_pct from k join o using (symbol)""")
def ownership_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each filing day the share of all stock that the freshest quarter visible then reports."""
    e = features.ownership_evolution(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    best = e.groupBy("symbol", "filed").agg(F.max(F.struct("period", "filed", "total_shares")).alias("best")).withColumn("best", F.max("best").over(w))
    stock = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg((F.sum("p_size") * 100.0).alias("outstanding"))
    return best.join(stock, "symbol").select("symbol", "filed", F.col("best.period").alias("period"), F.round(F.try_divide("best.total_shares", "outstanding"), 8).alias("inst_ownership_pct"))


SCORED, MOVED, REALISED = 60, 5, 20


def _z_sql(c: str) -> str:
    return f"round(case when count({c}) over z >= {SCORED} then ({c} - avg({c}) over z) / nullif(round(stddev_samp({c}) over z, 12), 0) end, 5)"


@book.query(f"""with a as ({features.book.oracles['atm_iv']}), t as ({features.book.oracles['iv_term_slope']}), k as ({features.book.oracles['skew_25d']}), g as ({features.book.oracles['option_positioning']}),
    p as (select underlying, quote_date::varchar as quote_date, avg(price) as spot from ({OPTIONS_SQL}) group by all),
    r as (select underlying, quote_date, ln(spot / lag(spot) over (partition by underlying order by quote_date)) as lr from p),
    v as (select underlying, quote_date, case when count(lr) over w >= {REALISED} then stddev_samp(lr) over w * sqrt(252) end as rv from r window w as (partition by underlying order by quote_date rows between {REALISED - 1} preceding and current row)),
    j as (select g.underlying, g.quote_date, atm_iv, iv_term_slope, skew_25d, net_gamma_exposure, rv from g left join a using (underlying,
        quote_date) left join t using (underlying, quote_date) left join k using (underlying, quote_date) left join v using (underlying, quote_date))
    select underlying, quote_date, atm_iv, {_z_sql('atm_iv')} as iv_zscore_60d, round(atm_iv - rv, 8) as vrp, iv_term_slope, {_z_sql('skew_25d')} as skew_zscore_60d,
        sign(net_gamma_exposure)::double as gex_sign, {_z_sql('net_gamma_exposure')} as gex_norm,
    round(atm_iv - lag(atm_iv, {MOVED}) over d, 8) as iv_delta_5d, round(iv_term_slope - lag(iv_term_slope, {MOVED}) over d, 8) as slope_delta_5d
    from j window d as (partition by underlying order by quote_date),
        z as (partition by underlying order by quote_date rows between {SCORED - 1} preceding and current row)""")
def chain_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine features of each underlying's regime: level, score, premium over realised volatility, term slope, crash pricing, gamma and moves."""
    keys = ["underlying", "quote_date"]
    w = Window.partitionBy("underlying").orderBy("quote_date")
    spot = options(spark, sf_dir).groupBy("underlying", F.col("quote_date").cast("string").alias("quote_date")).agg(F.avg("price").alias("spot"))
    moved = spot.withColumn("lr", F.ln(F.col("spot") / F.lag("spot").over(w)))
    realised = moved.select(*keys, (rolling(F.stddev_samp("lr"), w, REALISED, "lr") * F.sqrt(F.lit(252))).alias("rv"))
    j = features.option_positioning(spark, sf_dir).select(*keys, "net_gamma_exposure")
    for part in (features.atm_iv, features.iv_term_slope, features.skew_25d):
        j = j.join(part(spark, sf_dir), keys, "left")
    j = j.join(realised, keys, "left")

    def z(c: str) -> Column:
        spread = F.round(rolling(F.stddev_samp(c), w, SCORED, c), 12)
        return F.round(F.try_divide(F.col(c) - rolling(F.avg(c), w, SCORED, c), spread), 5)

    delta = lambda c: F.round(F.col(c) - F.lag(c, MOVED).over(w), 8)
    return j.select(
        *keys, "atm_iv", z("atm_iv").alias("iv_zscore_60d"), F.round(F.col("atm_iv") - F.col("rv"), 8).alias("vrp"), "iv_term_slope", z("skew_25d").alias("skew_zscore_60d"),
        F.signum("net_gamma_exposure").alias("gex_sign"), z("net_gamma_exposure").alias("gex_norm"), delta("atm_iv").alias("iv_delta_5d"), delta("iv_term_slope").alias("slope_delta_5d"),
    )
