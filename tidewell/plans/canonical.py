"""Raw rows to canonical tables: dedup, validation, calendar filling, hashes and incremental high-water marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import date_text, day_number, symbol
from tidewell.operators.latest import compare, latest, preserving, row_hash, set_hash, upsert
from tidewell.plans.base import BARS_SQL, METRICS_SQL, PRICES, RAW_BARS_SQL, TRADES_SQL, Book, bars, metrics, raw_bars, trades
from tidewell.session import table

book = Book()
STATS_ROWS, STATS_LEAST, STATS_Z = 60, 20, 5.0


@book.query(f"select symbol, timestamp, open, high, low, close, volume::double as volume, bar_id from ({BARS_SQL})")
def canonical_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of each bar."""
    return bars(spark, sf_dir).select("symbol", "timestamp", *PRICES, F.col("volume").cast("double").alias("volume"), "bar_id")


@book.query(f"""
    with b as ({BARS_SQL}),
    last60 as (select * from b where close > 0 qualify row_number() over (partition by symbol order by timestamp desc) <= {STATS_ROWS}),
    s as (select symbol, avg(close) as m, stddev_samp(close) as sd, count(*) as n from last60 group by symbol),
    v as (select b.bar_id, (open is null or high is null or low is null or close is null or volume is null) as missing, coalesce(least(open, high, low, close) <= 0,
        false) as low,
          coalesce(n >= {STATS_LEAST} and sd > 0 and close > 0 and abs(close - m) / sd > {STATS_Z}, false) as outlier from b left join s using (symbol))
    select bar_id, case when missing or low then 'failed' when outlier then 'warning' else 'passed' end as status from v""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each canonical bar's status from missing fields, prices not above zero and distance from the last closes."""
    return validated(bars(spark, sf_dir)).select("bar_id", "status")


def validated(b: DataFrame) -> DataFrame:
    """Adds warnings (an array of texts) and status: failed, warning or passed."""
    recent = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc())
    last = b.where("close > 0").withColumn("_k", F.row_number().over(recent)).where(F.col("_k") <= STATS_ROWS)
    stats = last.groupBy("symbol").agg(F.avg("close").alias("_m"), F.stddev_samp("close").alias("_sd"), F.count("*").alias("_n"))
    z = F.abs(F.col("close") - F.col("_m")) / F.col("_sd")
    far = (F.col("_n") >= STATS_LEAST) & (F.col("_sd") > 0) & (F.col("close") > 0) & (z > STATS_Z)
    failed = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in (*PRICES, "volume")], *[F.when(F.col(c) <= 0, F.concat(F.lit(f"non_positive_{c}="), F.col(c).cast("string"))) for c in PRICES]))
    warned = F.array_compact(F.array(F.when(far, F.concat(F.lit("outlier_close_z="), F.format_string("%.2f", z)))))
    out = b.join(stats, "symbol", "left").withColumn("_f", failed).withColumn("_w", warned)
    status = F.when(F.size("_f") > 0, "failed").when(F.size("_w") > 0, "warning").otherwise("passed")
    return out.withColumn("warnings", F.concat("_f", "_w")).withColumn("status", status).drop("_m", "_sd", "_n", "_f", "_w")


_MISSING_SQL = ", ".join(f"case when {c} is null then 'missing_{c}' end" for c in (*PRICES, "volume"))
_LOW_SQL = ", ".join(f"case when {c} <= 0 then 'non_positive_{c}=' || {c}::varchar end" for c in PRICES)


@book.query(f"""
    with b as ({BARS_SQL}),
    last60 as (select * from b where close > 0 qualify row_number() over (partition by symbol order by timestamp desc) <= {STATS_ROWS}),
    s as (select symbol, avg(close) as m, stddev_samp(close) as sd, count(*) as n from last60 group by symbol),
    w as (select bar_id, unnest([{_MISSING_SQL}, {_LOW_SQL}, case when n >= {STATS_LEAST} and sd > 0 and close > 0 and abs(close - m) / sd > {STATS_Z} then 'outlier_close_z=' || printf('%.2f', abs(close - m) / sd) end]) as warning from b left join s using (symbol))
    select bar_id, warning from w where warning is not null""")
def validation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each canonical bar's warnings as texts, one row each."""
    return validated(bars(spark, sf_dir)).select("bar_id", F.explode("warnings").alias("warning"))


@book.query(f"""
    select symbol, count(*) as deliveries, count(distinct timestamp) as days, count(*) - count(distinct timestamp) as superseded,
    max(ingested_at) as last_ingested from ({RAW_BARS_SQL}) group by symbol""")
def reconciliation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol how many deliveries were reconciled into how many days."""
    return raw_bars(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("deliveries"), F.countDistinct("timestamp").alias("days"), (F.count("*") - F.countDistinct("timestamp")).alias("superseded"), F.max("ingested_at").alias("last_ingested")
    )


@book.query("""
    select upper(trim(symbol)) as symbol, upper(trim(fiscal_period)) as fiscal_period, period, arg_max(fund_id, (report_date, coalesce(ingested_at,
        '0001-01-01'::timestamp), fund_id)) as fund_id
    from raw_fd_fundamentals group by all""")
def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last filing of each statement key as spelled."""
    df = table(spark, sf_dir, "raw_fd_fundamentals").select(symbol("symbol").alias("symbol"), F.upper(F.trim("fiscal_period")).alias("fiscal_period"), "period", "report_date", "ingested_at", "fund_id")
    return latest(df, by=["symbol", "fiscal_period", "period"], order=["report_date", "ingested_at", "fund_id"]).select("symbol", "fiscal_period", "period", "fund_id")


@book.query(f"select trade_id, symbol, strftime(filed_day, '%Y-%m-%d') as filed_day, total_value from ({TRADES_SQL})")
def insider_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider trades once per key, the latest ingested."""
    return trades(spark, sf_dir).select("trade_id", "symbol", F.col("filed_day").cast("string").alias("filed_day"), "total_value")


@book.query(f"""
    with o as (select * from ({METRICS_SQL}) qualify row_number() over (partition by symbol, timestamp::date order by timestamp desc, ingested_at desc nulls last,
        metric_id desc) = 1),
    d as (select symbol, unnest(generate_series(min(timestamp::date), max(timestamp::date), interval 1 day))::date as day from o group by symbol)
    select d.symbol, strftime(d.day, '%Y-%m-%d') as day, o.metric_id, o.market_cap, o.shares_outstanding from d asof left join (select *,
        timestamp::date as od from o) o on o.symbol = d.symbol and d.day >= o.od""")
def metrics_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per symbol and calendar day, the last known row carried forward."""
    one = latest(metrics(spark, sf_dir).withColumn("day", day_number("timestamp")), by=["symbol", "day"], order=["timestamp", "ingested_at", "metric_id"])
    ahead = F.lead("day").over(Window.partitionBy("symbol").orderBy("day"))
    filled = one.withColumn("_end", F.coalesce(ahead - 1, F.col("day"))).withColumn("day", F.explode(F.sequence("day", "_end")))
    return filled.select("symbol", date_text(F.col("day")).alias("day"), "metric_id", "market_cap", "shares_outstanding")


@book.query(f"""
    select symbol, arg_max(metric_id, (timestamp, coalesce(ingested_at, '0001-01-01'::timestamp), metric_id)) as metric_id,
    arg_max(pe_ratio, (timestamp, coalesce(ingested_at, '0001-01-01'::timestamp), metric_id)) filter (pe_ratio is not null) as pe_ratio,
    arg_max(shares_outstanding, (timestamp, coalesce(ingested_at, '0001-01-01'::timestamp),
        metric_id)) filter (shares_outstanding is not null) as shares_outstanding from ({METRICS_SQL}) group by symbol""")
def latest_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest metrics row per symbol, with older values where it has none."""
    m = metrics(spark, sf_dir).select("symbol", "timestamp", "ingested_at", "metric_id", "pe_ratio", "shares_outstanding")
    return preserving(m, by=["symbol"], order=["timestamp", "ingested_at", "metric_id"], keep=["pe_ratio", "shares_outstanding"]).select("symbol", "metric_id", "pe_ratio", "shares_outstanding")


@book.query(f"""
    with b as ({BARS_SQL}), a as (select distinct on (symbol, timestamp) symbol, timestamp, close, bar_id from ({RAW_BARS_SQL}) order by symbol, timestamp,
        ingested_at nulls first, bar_id)
    select b.symbol, b.timestamp, 'differs' as kind, a.close as left_close, b.close as right_close from a join b using (symbol, timestamp)
    where coalesce(abs(a.close - b.close) > 0.01, (a.close is null) <> (b.close is null))""")
def revised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose first and last delivery differ in their close."""
    raw = raw_bars(spark, sf_dir)
    first = raw.groupBy("symbol", "timestamp").agg(F.min_by(F.struct("close", "bar_id"), F.struct("ingested_at", "bar_id")).getField("close").alias("close"))
    return compare(first, bars(spark, sf_dir).select("symbol", "timestamp", "close"), by=["symbol", "timestamp"], tolerances={"close": 0.01})


@book.query(f"select symbol, timestamp, close, volume::double as volume from ({BARS_SQL})")
def upserted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late deliveries merged into the early ones by key: the same as reconciling all at once."""
    raw = raw_bars(spark, sf_dir)
    late = F.col("ingested_at") > F.col("timestamp") + F.expr("interval 2 days")
    late = F.coalesce(late, F.lit(False))
    order = ["ingested_at", "bar_id"]
    early = latest(raw.where(~late), by=["symbol", "timestamp"], order=order)
    return upsert(early, raw.where(late), by=["symbol", "timestamp"], order=order).select("symbol", "timestamp", "close", F.col("volume").cast("double").alias("volume"))


@book.query(f"""with h as (select symbol, sha256(concat_ws(chr(31), coalesce(symbol, '\\N'), strftime(timestamp, '%Y-%m-%d %H:%M:%S'),
        {', '.join(f"coalesce({c}::decimal(38, 8)::varchar, '\\N')" for c in PRICES)}, coalesce(volume::varchar, '\\N'))) as h from ({BARS_SQL}))
    select symbol, sha256({" || ',' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::bigint::varchar" for i in range(4))} || ',' || count(*)::varchar) as hash, count(*) as rows from h group by symbol""")
def symbol_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each symbol's canonical rows: changes when any value does, not with the order of rows."""
    b = bars(spark, sf_dir)
    return b.withColumn("h", row_hash(b, ["symbol", "timestamp", *PRICES, "volume"])).groupBy("symbol").agg(set_hash("h").alias("hash"), F.count("*").alias("rows"))


@book.query(f"""
    with b as ({BARS_SQL}), m as (select symbol, min(timestamp) + (max(timestamp) - min(timestamp)) / 2 as mark from b group by symbol)
    select symbol, date_trunc('day', mark) as watermark, count(*) filter (b.timestamp > date_trunc('day', mark)) as fresh,
        count(*) filter (b.timestamp > date_trunc('day', mark) - interval 99 days) as loaded
    from b join m using (symbol) group by all""")
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol a high-water mark, the bars after it and the bars to load for a lookback of 63 rows (1.5 times as many days, and 5)."""
    b = bars(spark, sf_dir)
    half = (F.min(F.unix_micros("timestamp")) + F.max(F.unix_micros("timestamp"))) / 2
    marks = b.groupBy("symbol").agg(F.date_trunc("day", F.timestamp_micros(F.floor(half))).alias("watermark"))
    start = F.col("watermark") - F.expr("interval 99 days")
    joined = b.join(marks, "symbol").where(F.col("timestamp") > start)
    return joined.groupBy("symbol", "watermark").agg(F.count_if(F.col("timestamp") > F.col("watermark")).alias("fresh"), F.count("*").alias("loaded"))
