"""Structured Streaming over bar messages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewell.operators.latest import latest
from tidewell.sources.readers import bar_messages
from tidewell.sources.writers import append_log, merge_table

FIELDS = ("open", "high", "low", "close", "volume")
PRICES = FIELDS[:4]


def with_status(bars: DataFrame) -> DataFrame:
    """Adds warnings and status: failed for missing fields, warning for prices not above zero, else passed. Works row by row, in batch and stream."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in FIELDS]
    low = [F.when(F.col(c) <= 0, F.lit(f"non_positive_{c}")) for c in PRICES]
    out = bars.withColumn("_m", F.array_compact(F.array(*missing))).withColumn("_l", F.array_compact(F.array(*low)))
    return out.withColumn("status", F.when(F.size("_m") > 0, "failed").when(F.size("_l") > 0, "warning").otherwise("passed")).withColumn("warnings", F.concat("_m", "_l")).drop("_m", "_l")


def canonicalize(messages: DataFrame, table: str, log: str, bad: str, checkpoint: str, text: str = "value") -> StreamingQuery:
    """Upsert the bars of a stream of message texts into the table by (symbol, timestamp); log each bar's status; keep texts that can't be read.

    Each batch is reduced to the last bar of each key, and only the months it touches are replaced, so a batch that is
    repeated after a failure leaves the table as it was. Runs until what is there has been read.
    """

    def store(batch: DataFrame, number: int) -> None:
        parsed = bar_messages(batch, text)
        append_log(parsed.where("bad is not null").select("bad"), bad, number)
        bars = with_status(parsed.where("bad is null").drop("bad")).withColumn("batch", F.lit(number))
        append_log(bars.select("symbol", "timestamp", "status", F.to_json("warnings").alias("warnings")), log, number)
        good = bars.where("status <> 'failed' and symbol is not null and timestamp is not null").drop("warnings")
        one = latest(good, by=["symbol", "timestamp"], order=["volume", "trade_count", "close"])
        merge_table(one.withColumn("month", F.date_format("timestamp", "yyyy-MM")), table, by=["symbol", "timestamp"], order=["batch"], partition="month")

    return messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, *, at: str, key: str, value: str, length: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Count, total, extremes and last value per window and key; rows later than late are dropped by the watermark in a stream. late of None: events has a watermark."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    marked = events.withWatermark(at, late) if late else events
    return marked.groupBy(w, key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(value, at).alias("open"), F.max_by(value, at).alias("close")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total", "low", "high", "open", "close")


def sessions(events: DataFrame, *, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after gap without an event."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(events: DataFrame, *, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of keys that arrive within late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def stale(events: DataFrame, *, at: str, key: str, now: str, after_seconds: int = 300) -> DataFrame:
    """Keys whose last event is older than after_seconds at the time now."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_at")
    return events.groupBy(key).agg(F.max(at).alias("last_at")).withColumn("age_seconds", age).where(F.col("age_seconds") > after_seconds)
