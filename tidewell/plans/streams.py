"""The streaming operators run over stored events, as a batch: the same code, the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.base import Book
from tidewell.session import table
from tidewell.streaming.bars import sessions, stale, windowed

book = Book()


@book.query("""select date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total,
        min(value) as low, max(value) as high from events group by all""")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows."""
    w = windowed(table(spark, sf_dir, "events"), at="ts", key="event_type", value="value")
    return w.select("start", "end", "event_type", "n", F.round("total", 4).alias("total"), "low", "high")


@book.query("""with e as (select *, s.i from events, (select unnest([0, 1]) as i) s) select date_trunc('hour', ts) - interval 1 hour * i as start, event_type,
        count(*) as n from e group by all""")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours that start every hour."""
    return windowed(table(spark, sf_dir, "events"), at="ts", key="event_type", value="value", length="2 hours", slide="1 hour").select("start", "event_type", "n")


@book.query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes then 1 else 0 end as brk from events), s as (select *, sum(brk) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after half an hour."""
    return sessions(table(spark, sf_dir, "events"), at="ts", key="user_id")


@book.query("""select user_id, max(ts) as last_at, (epoch(timestamp '2024-01-31') ::bigint - floor(epoch(max(ts)))::bigint) as age_seconds from events group by user_id having epoch(timestamp '2024-01-31')::bigint - floor(epoch(max(ts)))::bigint > 86400""")
def stale_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event for a day."""
    return stale(table(spark, sf_dir, "events"), at="ts", key="user_id", now="2024-01-31", after_seconds=86_400)
