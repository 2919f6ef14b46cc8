"""Scans, filters, joins, sets and top-k over the canonical and star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import symbol
from tidewell.operators.latest import compare, latest
from tidewell.plans.base import BARS_SQL, BENCHMARK, SOUND_SQL, TRADES_SQL, Book, bars, sound_bars, trades
from tidewell.session import table

book = Book()


@book.query(f"select symbol, timestamp, close, volume::double as volume from ({BARS_SQL}) where timestamp between '2024-01-01' and '2024-03-31 23:59:59.999999' and symbol <> '{BENCHMARK}'")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a closed range of days: the range reaches the scan."""
    raw = table(spark, sf_dir, "raw_alpaca_equity_ohlcv").where(F.col("timestamp").between(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-03-31 23:59:59.999999").cast("timestamp")) & (symbol("symbol") != BENCHMARK))
    one = latest(raw.select(symbol("symbol").alias("symbol"), "timestamp", F.when(~F.isnan("close"), F.col("close")).alias("close"), "volume", "ingested_at", "bar_id"), by=["symbol", "timestamp"], order=["ingested_at", "bar_id"])
    return one.select("symbol", "timestamp", "close", F.col("volume").cast("double").alias("volume"))


@book.query(f"select trade_id, symbol from ({TRADES_SQL}) where filed_day >= date '2024-03-01' - 90 and filed_day <= date '2024-03-31'")
def lookback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a range whose start is moved back by the lookback of the features made from them."""
    t = trades(spark, sf_dir)
    return t.where((F.col("filed_day") >= F.date_sub(F.lit("2024-03-01").cast("date"), 90)) & (F.col("filed_day") <= F.lit("2024-03-31").cast("date"))).select("trade_id", "symbol")


@book.query("select doc_id from documents where contains(lower(text), 'impairment') or contains(lower(source), 'wire')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over several columns, whatever the case."""
    has = lambda c, q: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return table(spark, sf_dir, "documents").where(has("text", "impairment") | has("source", "wire")).select("doc_id")


@book.query("select event_type, count(*) as events, count(distinct user_id) as users, min(ts) as first_ts, max(ts) as last_ts, sum((props::json ->> 'k')::bigint) as k_total from events where ts > timestamp '2024-01-31' - interval 14 days group by event_type")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of recent events with a field read from their JSON."""
    e = table(spark, sf_dir, "events").where(F.col("ts") > F.lit("2024-01-31").cast("timestamp") - F.expr("interval 14 days"))
    k = F.from_json("props", "k long").getField("k")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(k).alias("k_total"))


@book.query(f"with b as ({SOUND_SQL}), u as (select upper(trim(symbol)) as symbol from raw_fd_fundamentals group by 1 having count(*) >= 10) select symbol, timestamp, close from b where symbol in (select symbol from u)")
def universe_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the symbols that have ten statement rows or more."""
    u = table(spark, sf_dir, "raw_fd_fundamentals").groupBy(symbol("symbol").alias("symbol")).count().where("count >= 10")
    return sound_bars(spark, sf_dir).join(u, "symbol", "left_semi").select("symbol", "timestamp", "close")


@book.query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@book.query(f"""with b as ({BARS_SQL}), m as (select upper(trim(symbol)) as symbol, timestamp::date as day,
        count(*) as readings from raw_fd_financial_metrics group by all)
    select coalesce(b.symbol, m.symbol) as symbol, strftime(coalesce(b.timestamp::date, m.day), '%Y-%m-%d') as day, b.close, coalesce(m.readings,
        0) as readings from b full join m on m.symbol = b.symbol and m.day = b.timestamp::date""")
def bars_and_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a bar, a reading or both: a full outer join."""
    b = bars(spark, sf_dir).select("symbol", F.to_date("timestamp").alias("day"), "close")
    m = table(spark, sf_dir, "raw_fd_financial_metrics").groupBy(symbol("symbol").alias("symbol"), F.to_date("timestamp").alias("day")).agg(F.count("*").alias("readings"))
    return b.join(m, ["symbol", "day"], "full_outer").select("symbol", F.col("day").cast("string").alias("day"), "close", F.coalesce("readings", F.lit(0)).alias("readings"))


@book.query(f"""with b as ({SOUND_SQL}), a as (select symbol, timestamp, avg(close) as vwap_close from (select upper(trim(symbol)) as symbol, timestamp,
        vwap as close from raw_alpaca_equity_ohlcv where vwap > 0 and not isnan(vwap)) group by all)
    select a.symbol, a.timestamp, round(coalesce(b.close, a.vwap_close), 6) as close from a left join b using (symbol, timestamp)""")
def close_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical close where there is one, else the average traded price."""
    raw = table(spark, sf_dir, "raw_alpaca_equity_ohlcv").where((F.col("vwap") > 0) & ~F.isnan("vwap"))
    a = raw.groupBy(symbol("symbol").alias("symbol"), "timestamp").agg(F.avg("vwap").alias("vwap_close"))
    b = sound_bars(spark, sf_dir).select("symbol", "timestamp", "close")
    return a.join(b, ["symbol", "timestamp"], "left").select("symbol", "timestamp", F.round(F.coalesce("close", "vwap_close"), 6).alias("close"))


@book.query("""with a as (select l_orderkey as k, round(sum(l_extendedprice * (1 - l_discount)), 4) as v from lineitem group by 1)
    select coalesce(k, o_orderkey) as k, case when o_orderkey is null then 'left_only' when k is null then 'right_only' else 'differs' end as kind, v as left_total,
        round(o_totalprice, 2) as right_total
    from a full join orders on k = o_orderkey where o_orderkey is null or k is null or abs(v - round(o_totalprice, 2)) > 0.01""")
def order_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines and header don't agree, or that lack one of them: a full outer comparison with a tolerance."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("total"))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("total"))
    return compare(lines, heads, by=["k"], tolerances={"total": 0.01})


@book.query("""select n_name, r_name, count(*) as customers, round(sum(c_acctbal),
        2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def nation_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins with small dimensions, which the optimizer sends out when they are under its size limit."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@book.query("select event_type, user_id, event_id, ts, value from events qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1")
def latest_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type and user."""
    return latest(table(spark, sf_dir, "events"), by=["event_type", "user_id"], order=["ts", "event_id"]).select("event_type", "user_id", "event_id", "ts", "value")


@book.query(f"with b as ({SOUND_SQL}) select timestamp, symbol, volume, k::int as k from (select *, row_number() over (partition by timestamp order by volume desc nulls last, symbol) as k from b) where k <= 5")
def top_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most traded symbols of each day."""
    k = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc_nulls_last("volume"), "symbol"))
    return sound_bars(spark, sf_dir).withColumn("k", k).where("k <= 5").select("timestamp", "symbol", "volume", "k")


@book.query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: sorted in each task, merged by the driver."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@book.query("""select s, sum(a) as in_bars, sum(m) as in_metrics, sum(t) as in_trades from (select distinct upper(trim(symbol)) as s, 1 as a, 0 as m,
        0 as t from raw_alpaca_equity_ohlcv union all
    select distinct upper(trim(symbol)), 0, 1, 0 from raw_fd_financial_metrics union all select distinct upper(trim(symbol)), 0, 0,
        1 from raw_fd_insider_trades) group by s""")
def symbol_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables know each symbol: a union of distinct sets."""
    names = {"in_bars": "raw_alpaca_equity_ohlcv", "in_metrics": "raw_fd_financial_metrics", "in_trades": "raw_fd_insider_trades"}
    each = [table(spark, sf_dir, t).select(symbol("symbol").alias("s")).distinct().select("s", *[F.lit(1 if c == n else 0).alias(c) for c in names]) for n, t in names.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("s").agg(*[F.sum(c).alias(c) for c in names])


@book.query("select upper(trim(symbol)) as symbol from raw_fd_insider_trades intersect select upper(trim(symbol)) from raw_fd_fundamentals")
def traded_and_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t: table(spark, sf_dir, t).select(symbol("symbol").alias("symbol"))
    return names("raw_fd_insider_trades").intersect(names("raw_fd_fundamentals"))


@book.query("select upper(trim(symbol)) as symbol from raw_alpaca_equity_ohlcv except select upper(trim(symbol)) from raw_fd_fundamentals")
def never_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t: table(spark, sf_dir, t).select(symbol("symbol").alias("symbol"))
    return names("raw_alpaca_equity_ohlcv").subtract(names("raw_fd_fundamentals"))


@book.query("""with b as (select user_id, ts, event_id, value, row_number() over (partition by user_id order by ts, event_id) as n,
        count(*) over (partition by user_id) as total from events)
    select user_id, ts, event_id, value from b where (n - 1) % greatest(ceil(total / 200.0)::bigint, 1) = 0""")
def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 evenly spaced events of each user, the first among them: a sampling operator."""
    w = Window.partitionBy("user_id")
    n = F.row_number().over(w.orderBy("ts", "event_id"))
    stride = F.greatest(F.ceil(F.count("*").over(w) / 200.0), F.lit(1))
    return table(spark, sf_dir, "events").withColumn("_n", n).withColumn("_s", stride).where((F.col("_n") - 1) % F.col("_s") == 0).select("user_id", "ts", "event_id", "value")


@book.query("""select user_id from (select user_id, event_type, row_number() over (partition by user_id order by ts desc,
        event_id desc) as n from events) where n <= 5 group by user_id having count(*) = 5 and count(distinct event_type) = 1""")
def livelocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last five events are all of one type."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = table(spark, sf_dir, "events").withColumn("n", n).where("n <= 5")
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("d")).where("n = 5 and d = 1").select("user_id")


@book.query("""select user_id, event_type, count(*) as n, grouping_id(user_id, event_type)::bigint as g from (select user_id % 10 as user_id,
        event_type from events) group by cube (user_id, event_type)""")
def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("user_id"), "event_type")
    return e.cube("user_id", "event_type").agg(F.count("*").alias("n"), F.grouping_id("user_id", "event_type").alias("g"))
