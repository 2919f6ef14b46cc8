"""Residual returns, betas, order checks, and ledgers of cash and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.series import simple_return
from tidewell.plans import features
from tidewell.plans.base import BENCHMARK, SOUND_SQL, TRADES_SQL, Book, by_symbol, sound_bars, trades
from tidewell.plans.books import momentum
from tidewell.session import table

book = Book()
_W = "partition by symbol order by timestamp"
MONEY = "decimal(28,8)"
START_CASH = 1_000_000


# ------------------------------------------------------------------ returns against the benchmark


@book.query(f"""with f as ({features.book.oracles['forward_returns']}), be as ({features.book.oracles['rolling_beta']}), k as (select timestamp,
        fwd_5d as bench from f where symbol = '{BENCHMARK}')
    select f.symbol, f.timestamp, round(fwd_5d - coalesce(beta_60d, 0) * coalesce(bench, 0),
        8) as residual_5d from f left join be on be.symbol = f.symbol and be.timestamp = f.timestamp left join k on k.timestamp = f.timestamp""")
def residual_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the next five bars less beta times the benchmark's; the benchmark's own stay, an unknown beta counts as none."""
    f = features.forward_returns(spark, sf_dir).select("symbol", "timestamp", "fwd_5d")
    bench = f.where(F.col("symbol") == BENCHMARK).select("timestamp", F.col("fwd_5d").alias("bench"))
    j = f.join(features.rolling_beta(spark, sf_dir), ["symbol", "timestamp"], "left").join(bench, "timestamp", "left")
    zero = F.lit(0.0)
    return j.select("symbol", "timestamp", F.round(F.col("fwd_5d") - F.coalesce("beta_60d", zero) * F.coalesce("bench", zero), 8).alias("residual_5d"))


BETA_BARS, BETA_CAP = 60, 0.5


@book.query(f"""with b as ({SOUND_SQL}), r as (select symbol, timestamp, close / lag(close) over ({_W}) - 1 as ret, close / lag(close,
        21) over ({_W}) - 1 as mom from b),
    k as (select timestamp, ret as rb from r where symbol = '{BENCHMARK}' and ret is not null),
    j as (select r.*, rb from r join k using (timestamp) where symbol <> '{BENCHMARK}' and ret is not null),
    c as (select symbol, timestamp, mom, case when count(*) over w >= 2 and round(var_samp(rb) over w, 15) > 0 then covar_samp(ret,
        rb) over w / var_samp(rb) over w else 0 end as beta from j
          window w as ({_W} rows between {BETA_BARS} preceding and 1 preceding)),
    t as (select timestamp, beta from (select *, row_number() over (partition by timestamp order by mom desc,
        symbol) as k from c where mom is not null) where k <= 5),
    p as (select timestamp, sum(0.2::double * beta) as beta from t group by timestamp)
    select timestamp, round(beta, 6) as beta, round(case when beta > {BETA_CAP} then {BETA_CAP}::double / beta else 1.0 end, 6) as scale from p""")
def beta_capped_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta of the five strongest symbols' book from the bars before each day, and the exposure that keeps it under the cap."""
    w = by_symbol()
    r = sound_bars(spark, sf_dir).select("symbol", "timestamp", simple_return("close", w).alias("ret"), simple_return("close", w, 21).alias("mom")).where("ret is not null")
    bench = r.where(F.col("symbol") == BENCHMARK).select("timestamp", F.col("ret").alias("rb"))
    j = r.where(F.col("symbol") != BENCHMARK).join(bench, "timestamp")
    back = w.rowsBetween(-BETA_BARS, -1)
    varied = (F.count(F.lit(1)).over(back) >= 2) & (F.round(F.var_samp("rb").over(back), 15) > 0)
    beta = F.when(varied, F.try_divide(F.covar_samp("ret", "rb").over(back), F.var_samp("rb").over(back))).otherwise(F.lit(0.0))
    c = j.withColumn("beta", beta).where("mom is not null")
    k = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("mom"), "symbol"))
    p = c.withColumn("k", k).where("k <= 5").groupBy("timestamp").agg(F.sum(0.2 * F.col("beta")).alias("beta"))
    scale = F.when(F.col("beta") > BETA_CAP, F.lit(BETA_CAP) / F.col("beta")).otherwise(F.lit(1.0))
    return p.select("timestamp", F.round("beta", 6).alias("beta"), F.round(scale, 6).alias("scale"))


# ------------------------------------------------------------------ ledgers

_FILLS_SQL = f"""select o_custkey as owner, p_brand as symbol, o_orderdate::date as day, (o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_partkey,
        l_extendedprice) as seq,
    case when l_returnflag = 'R' then -l_quantity else l_quantity end as q, l_extendedprice / l_quantity as price,
        (case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end)::{MONEY} as paid
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of each owner in order: star-schema adapter, returned lines sell."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    sold = F.col("l_returnflag") == "R"
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.col("o_custkey").alias("owner"), F.col("p_brand").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("seq"),
        F.when(sold, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(sold, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(MONEY).alias("paid"),
    )


_SNAPSHOTS_SQL = f"""with f as ({_FILLS_SQL}),
    v as (select *, ((sum(q) over (partition by owner, symbol order by seq)) * price)::{MONEY} as value from f),
    d as (select *, value - coalesce(lag(value) over (partition by owner, symbol order by seq), 0) as moved,
        abs(value) - coalesce(lag(abs(value)) over (partition by owner, symbol order by seq), 0) as moved_gross from v),
    c as (select owner, day, sum(moved) as moved, sum(moved_gross) as moved_gross, sum(paid) as paid from d group by all),
    r as (select owner, day, sum(moved) over w as net, sum(moved_gross) over w as gross,
        {START_CASH} - sum(paid) over w as cash from c window w as (partition by owner order by day)),
    n as (select *, net + cash as nav from r), p as (select *, greatest(max(nav) over (partition by owner order by day), 0) as peak from n)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner and day after its fills: net, gross, cash, nav and peak, positions at the last price seen, as decimals.

    Each fill moves the value of one position; what it moves is added up per day first, so a running sum per owner is all that
    is ordered.
    """
    w = Window.partitionBy("owner", "symbol").orderBy("seq")
    v = fills(spark, sf_dir).withColumn("value", (F.sum("q").over(w) * F.col("price")).cast(MONEY))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0).cast(MONEY))
    d = v.select("owner", "day", "paid", (F.col("value") - before(F.col("value"))).alias("moved"), (F.abs("value") - before(F.abs("value"))).alias("moved_gross"))
    c = d.groupBy("owner", "day").agg(*[F.sum(x).cast(MONEY).alias(x) for x in ("moved", "moved_gross", "paid")])
    days = Window.partitionBy("owner").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda x: F.sum(x).over(days).cast(MONEY)  # noqa: E731  (a wider type would lose places when added)
    r = c.select("owner", "day", so_far("moved").alias("net"), so_far("moved_gross").alias("gross"), (F.lit(START_CASH) - so_far("paid")).cast(MONEY).alias("cash"))
    n = r.withColumn("nav", (F.col("net") + F.col("cash")).cast(MONEY))
    return n.withColumn("peak", F.greatest(F.max("nav").over(days), F.lit(0).cast(MONEY)))


@book.query(f"""{_SNAPSHOTS_SQL} select owner, day::varchar as day, round(nav, 4)::double as nav, round(cash, 4)::double as cash, round(gross,
        4)::double as gross_exposure, round(net, 4)::double as net_exposure,
    round(case when nav > 0 then gross::double / nav::double else 0 end, 10) as leverage, round(peak, 4)::double as peak_nav,
        round(case when peak > 0 then (nav - peak)::double / peak::double else 0 end, 10) as drawdown from p""")
def portfolio_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each owner's portfolio after each day with fills."""
    s = snapshots(spark, sf_dir)
    num = lambda c: F.col(c).cast("double")
    money = lambda c, n: F.round(c, 4).cast("double").alias(n)
    leverage = F.when(F.col("nav") > 0, num("gross") / num("nav")).otherwise(F.lit(0.0))
    fallen = F.when(F.col("peak") > 0, (F.col("nav") - F.col("peak")).cast("double") / num("peak")).otherwise(F.lit(0.0))
    return s.select(
        "owner", F.col("day").cast("string").alias("day"), money("nav", "nav"), money("cash", "cash"), money("gross", "gross_exposure"), money("net", "net_exposure"),
        F.round(leverage, 10).alias("leverage"), money("peak", "peak_nav"), F.round(fallen, 10).alias("drawdown"),
    )


@book.query(f"""{_SNAPSHOTS_SQL} select owner, day::varchar as day, round(nav - first_value(nav) over (partition by owner, date_trunc('quarter', day) order by day),
        4)::double as pnl from p""")
def session_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain since the first snapshot of each session, here a quarter."""
    first = F.first("nav").over(Window.partitionBy("owner", F.date_trunc("quarter", "day")).orderBy("day"))
    return snapshots(spark, sf_dir).select("owner", F.col("day").cast("string").alias("day"), F.round(F.col("nav") - first, 4).cast("double").alias("pnl"))


RESTART = "2023-06-30"


@book.query(f"""{_SNAPSHOTS_SQL}, l as (select owner, arg_max(cash, day) as cash, arg_max(peak, day) as peak from p where day <= date '{RESTART}' group by owner),
    a as (select owner, sum(paid) as paid, count(*) as fills from f where day > date '{RESTART}' group by owner),
    h as (select owner, symbol, sum(q) as q, sum(case when q > 0 then q * price end)::{MONEY} / nullif(sum(case when q > 0 then q end),
        0) as cost from f group by all),
    e as (select owner, sum((q * coalesce(cost, 0))::{MONEY}) as net from h group by owner)
    select e.owner, coalesce(fills, 0) as fills_since, round(coalesce(cash, {START_CASH}) - coalesce(paid, 0), 4)::double as cash, round(net + coalesce(cash,
        {START_CASH}) - coalesce(paid, 0), 3)::double as nav
    from e left join l using (owner) left join a using (owner)""")
def recovered_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash and value after a restart: the last snapshot's cash, moved by the fills since, and positions at their average cost of buying."""
    day = F.lit(RESTART).cast("date")
    last = snapshots(spark, sf_dir).where(F.col("day") <= day).groupBy("owner").agg(F.max_by("cash", "day").alias("cash"))
    f = fills(spark, sf_dir)
    since = f.where(F.col("day") > day).groupBy("owner").agg(F.sum("paid").alias("paid"), F.count("*").alias("fills"))
    bought = F.when(F.col("q") > 0, F.col("q"))
    held = f.groupBy("owner", "symbol").agg(F.sum("q").alias("q"), F.try_divide(F.sum(bought * F.col("price")).cast(MONEY).cast("double"), F.sum(bought)).alias("cost"))
    net = held.groupBy("owner").agg(F.sum((F.col("q") * F.coalesce("cost", F.lit(0.0))).cast(MONEY)).cast(MONEY).alias("net"))
    j = net.join(last, "owner", "left").join(since, "owner", "left")
    cash = (F.coalesce("cash", F.lit(START_CASH).cast(MONEY)) - F.coalesce(F.col("paid").cast(MONEY), F.lit(0).cast(MONEY))).cast(MONEY)
    return j.select("owner", F.coalesce("fills", F.lit(0)).alias("fills_since"), F.round(cash, 4).cast("double").alias("cash"), F.round(F.col("net") + cash, 3).cast("double").alias("nav"))


# ------------------------------------------------------------------ orders

#: Limits of the checks before a trade, as shares of the portfolio's value, and the most positions.
LEAST_ORDER, MOST_SYMBOL, MOST_POSITIONS, MOST_GROSS, LEAST_CASH = 0.01, 0.20, 20, 1.0, 0.02
_HELD_SQL = f"select owner, symbol, sum(q) as q, abs(sum(paid)) as value from ({_FILLS_SQL}) group by all"


@book.query(f"""with h as ({_HELD_SQL}), g as (select owner, sum(value) as gross, count(*) filter (q > 0) as positions, 1.25::decimal(4,
        2) * sum(value) as nav from h group by owner),
    o as (select o_orderkey, o_custkey as owner, o_totalprice::{MONEY} as notional, case when o_orderstatus = 'P' then 'sell' else 'buy' end as side, arg_min(p_brand,
        (l_linenumber, l_partkey)) as symbol
          from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all),
    j as (select o.*, coalesce(nav, 0)::double as nav, coalesce(gross, 0)::double as gross, coalesce(positions, 0) as positions, coalesce(h.value, 0)::double as held,
        coalesce(h.q, 0) > 0 as holds, o.notional::double as n
          from o left join g using (owner) left join h on h.owner = o.owner and h.symbol = o.symbol),
    r as (select o_orderkey, nav, concat_ws(',',
        case when nav <= 0 then 'nav_check' end, case when nav > 0 and n / nav < {LEAST_ORDER} then 'minimum_order_threshold' end,
        case when nav > 0 and (case when side = 'buy' then held + n else greatest(held - n, 0) end) / nav > {MOST_SYMBOL} then 'max_symbol_weight' end,
        case when nav > 0 and side = 'buy' and not holds and positions >= {MOST_POSITIONS} then 'max_active_positions' end,
        case when nav > 0 and (case when side = 'buy' then gross + n else gross - n end) / nav > {MOST_GROSS} then 'max_gross_exposure' end,
        case when nav > 0 and (case when side = 'buy' then nav - gross - n else nav - gross + n end) / nav < {LEAST_CASH} then 'min_cash' end) as reasons from j)
    select o_orderkey, case when reasons = '' then 'pass' else 'reject' end as decision, reasons from r""")
def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against its owner's positions: too small, too much of one symbol, too many positions, too much in all, too little cash."""
    h = fills(spark, sf_dir).groupBy("owner", "symbol").agg(F.sum("q").alias("q"), F.abs(F.sum("paid")).alias("value"))
    g = h.groupBy("owner").agg(F.sum("value").alias("gross"), F.count_if(F.col("q") > 0).alias("positions"))
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    first = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.min_by("p_brand", F.struct("l_linenumber", "l_partkey")).alias("symbol"))
    side = F.when(F.col("o_orderstatus") == "P", "sell").otherwise("buy")
    asked = o.join(first, o.o_orderkey == first.l_orderkey).select("o_orderkey", F.col("o_custkey").alias("owner"), F.col("o_totalprice").cast(MONEY).cast("double").alias("n"), side.alias("side"), "symbol")
    zero = F.lit(0)
    j = asked.join(g, "owner", "left").join(h, ["owner", "symbol"], "left").select(
        "o_orderkey", "n", (F.col("side") == "buy").alias("buys"), (F.coalesce("gross", zero) * F.lit(1.25).cast("decimal(4,2)")).cast("double").alias("nav"), F.coalesce("gross", zero).cast("double").alias("gross"),
        F.coalesce("positions", zero).alias("positions"), F.coalesce("value", zero).cast("double").alias("held"), (F.coalesce("q", F.lit(0.0)) > 0).alias("holds"),
    )
    n, nav, gross, held, buys = (F.col(c) for c in ("n", "nav", "gross", "held", "buys"))
    share = lambda of: F.try_divide(of, nav)
    after = lambda bought, sold: F.when(buys, bought).otherwise(sold)
    rules = {
        "nav_check": nav <= 0, "minimum_order_threshold": (nav > 0) & (share(n) < LEAST_ORDER), "max_symbol_weight": (nav > 0) & (share(after(held + n, F.greatest(held - n, F.lit(0.0)))) > MOST_SYMBOL),
        "max_active_positions": (nav > 0) & buys & ~F.col("holds") & (F.col("positions") >= MOST_POSITIONS), "max_gross_exposure": (nav > 0) & (share(after(gross + n, gross - n)) > MOST_GROSS),
        "min_cash": (nav > 0) & (share(after(nav - gross - n, nav - gross + n)) < LEAST_CASH),
    }
    told = j.select("o_orderkey", F.concat_ws(",", *[F.when(broken, F.lit(name)) for name, broken in rules.items()]).alias("reasons"))
    return told.select("o_orderkey", F.when(F.col("reasons") == "", "pass").otherwise("reject").alias("decision"), "reasons")


NAV, LEAST_NOTIONAL, MOST_WEIGHT = 1_000_000.0, 1.0, 0.2
_SIGNALS_SQL = f"""b as ({SOUND_SQL}), m as (select symbol, timestamp, close, close / lag(close, 21) over ({_W}) - 1 as mom from b),
    s as (select symbol, arg_max(round(least(greatest(mom, 0), {MOST_WEIGHT}), 6), timestamp) as target from m where mom is not null group by symbol),
    c as (select symbol, arg_max(close, timestamp) as price from b group by symbol),
    h as (select symbol, round(sum(case when transaction_type = 'Open market purchase' then shares when transaction_type = 'Open market sale' then -shares end) / 1000, 6) as quantity from ({TRADES_SQL}) group by symbol having quantity is not null)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signal of each symbol: the weight that its momentum asks for."""
    asked = F.round(F.least(F.greatest(F.col("mom"), F.lit(0.0)), F.lit(MOST_WEIGHT)), 6)
    return momentum(spark, sf_dir).where("mom is not null").groupBy("symbol").agg(F.max_by(asked, "timestamp").alias("target"))


def stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity held of each symbol: thousandths of what insiders bought on balance."""
    kind = F.col("transaction_type")
    moved = F.when(kind == "Open market purchase", F.col("shares")).when(kind == "Open market sale", -F.col("shares"))
    return trades(spark, sf_dir).groupBy("symbol").agg(F.round(F.sum(moved) / 1000, 6).alias("quantity")).where("quantity is not null")


def last_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sound_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "timestamp").alias("price"))


@book.query(f"""with {_SIGNALS_SQL}, j as (select s.symbol, {NAV} * target as desired, coalesce(quantity * price, 0) as current,
        quantity is null as none from s left join h using (symbol) left join c using (symbol))
    select symbol, round(desired, 4) as desired_notional, round(current, 4) as current_notional, round(desired - current, 4) as delta_notional,
    case when abs(desired) < 1e-10 and none then 'zero_target' when abs(desired - current) < {LEAST_NOTIONAL} then 'below_threshold' else 'order_generated' end as reason,
    case when (abs(desired) < 1e-10 and none) or abs(desired - current) < {LEAST_NOTIONAL} then null when desired > current then 'buy' else 'sell' end as side from j""")
def signal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that bring each symbol from what is held to what its last signal asks for; the smallest are left out."""
    j = signals(spark, sf_dir).join(stakes(spark, sf_dir), "symbol", "left").join(last_prices(spark, sf_dir), "symbol", "left")
    j = j.select("symbol", (NAV * F.col("target")).alias("desired"), F.coalesce(F.col("quantity") * F.col("price"), F.lit(0.0)).alias("current"), F.col("quantity").isNull().alias("none"))
    delta = F.col("desired") - F.col("current")
    nothing, small = (F.abs("desired") < 1e-10) & F.col("none"), F.abs(delta) < LEAST_NOTIONAL
    return j.select(
        "symbol", F.round("desired", 4).alias("desired_notional"), F.round("current", 4).alias("current_notional"), F.round(delta, 4).alias("delta_notional"),
        F.when(nothing, "zero_target").when(small, "below_threshold").otherwise("order_generated").alias("reason"), F.when(~nothing & ~small, F.when(delta > 0, "buy").otherwise("sell")).alias("side"),
    )


@book.query(f"""with {_SIGNALS_SQL}, w as (select symbol, quantity * price / {NAV} as weight from h join c using (symbol))
    select symbol, round(coalesce(target, weight), 8) as target, round(coalesce(weight, 0), 8) as current, s.symbol is null as kept from s full join w using (symbol)""")
def live_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights of all symbols with a signal or a holding: a holding without a signal keeps its weight."""
    held = stakes(spark, sf_dir).join(last_prices(spark, sf_dir), "symbol").select("symbol", (F.col("quantity") * F.col("price") / NAV).alias("weight"))
    j = signals(spark, sf_dir).withColumn("asked", F.lit(True)).join(held, "symbol", "full_outer")
    return j.select("symbol", F.round(F.coalesce("target", "weight"), 8).alias("target"), F.round(F.coalesce("weight", F.lit(0.0)), 8).alias("current"), F.col("asked").isNull().alias("kept"))


@book.query("""select o_orderpriority as venue, count(*) as orders, round(count(*) filter (o_orderstatus = 'F') / count(*), 8) as fill_rate,
        round(count(*) filter (o_orderstatus = 'O') / count(*), 8) as pending_rate,
    round(count(*) filter (o_orderstatus = 'P') / count(*), 8) as reject_rate from orders group by all""")
def order_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of filled, open and refused orders."""
    rate = lambda s, n: F.round(F.count_if(F.col("o_orderstatus") == s) / F.count("*"), 8).alias(n)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("venue")).agg(F.count("*").alias("orders"), rate("F", "fill_rate"), rate("O", "pending_rate"), rate("P", "reject_rate"))


@book.query("""with f as (select l_orderkey, sum(l_quantity) as filled from lineitem where l_linestatus = 'F' group by all), a as (select l_orderkey,
        sum(l_quantity) as asked from lineitem group by all)
    select action, count(*) as orders, round(sum(asked - coalesce(filled, 0)), 2) as open_quantity from (select o_orderkey, asked, filled,
    case when asked is null then 'missing' when coalesce(filled,
        0) >= asked then 'mark_filled' when filled > 0 then 'mark_partial' when o_orderstatus = 'P' then 'mark_cancelled' else 'keep_open' end as action
    from orders left join a on a.l_orderkey = o_orderkey left join f on f.l_orderkey = o_orderkey) group by action""")
def pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each order when its state is compared with its fills."""
    li = table(spark, sf_dir, "lineitem")
    done = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("asked"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("filled"))
    j = table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    filled = F.coalesce("filled", F.lit(0.0))
    action = (
        F.when(F.col("asked").isNull(), "missing").when(filled >= F.col("asked"), "mark_filled").when(F.col("filled") > 0, "mark_partial")
        .when(F.col("o_orderstatus") == "P", "mark_cancelled").otherwise("keep_open")
    )
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("asked") - filled), 2).alias("open_quantity"))


@book.query("""select (props::json ->> 'k')::bigint as run_id, min(ts) as started, max(ts) as ended, count(*) as steps from events group by all""")
def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time and steps of each run, whose number is read from JSON."""
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k long").getField("k").alias("run_id"), "ts")
    return e.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("steps"))


@book.query("""with m as (select c_mktsegment as s, n_name as k, round(avg(c_acctbal), 6) as v from customer join nation on c_nationkey = n_nationkey group by all),
    a as (select k, v from m where s = 'BUILDING'), b as (select k, v from m where s = 'MACHINERY')
    select k, a.v as first, b.v as second, round(b.v - a.v, 6) as difference,
        case when a.v is null then 'added' when b.v is null then 'removed' when a.v = b.v then 'same' else 'changed' end as kind from a full join b using (k)""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs key by key, over all keys of either: what was added, removed or changed, and by how much."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    m = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("s"), F.col("n_name").alias("k")).agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    a, b = (m.where(F.col("s") == s).select("k", F.col("v").alias(name)) for s, name in (("BUILDING", "first"), ("MACHINERY", "second")))
    kind = F.when(F.col("first").isNull(), "added").when(F.col("second").isNull(), "removed").when(F.col("first") == F.col("second"), "same").otherwise("changed")
    return a.join(b, "k", "full_outer").select("k", "first", "second", F.round(F.col("second") - F.col("first"), 6).alias("difference"), kind.alias("kind"))
