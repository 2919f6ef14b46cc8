"""Tolerant readers: values that can't be read become null, whole bad records are kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.schemas import BAR_COLUMNS


def to_number(c: Column | str) -> Column:
    """A finite double, or null for text that is none."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def to_time(c: Column | str) -> Column:
    """A timestamp from ISO text, from yyyyMMdd, or from epoch seconds or milliseconds; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    compact = F.when(text.rlike(r"^(?:19|20)\d{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    number = F.when(text.rlike(r"^\d{9,13}$"), text.try_cast("long"))
    epoch = F.when(number >= 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.coalesce(compact, F.when(number.isNotNull(), epoch), F.when(~text.rlike(r"^\d+$"), text.try_cast("timestamp")))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header by a fixed schema; unreadable fields are null and the record's text is kept in _bad."""
    wanted = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    return spark.read.csv(path, header=True, schema=wanted, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema; a line that can't be read is kept in _bad."""
    wanted = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    return spark.read.json(path, schema=wanted, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def csv_text(df: DataFrame, column: str, schema: str, separator: str = ",") -> DataFrame:
    """The fields of CSV texts in a column, by a fixed schema; fields that can't be read are null. Other columns stay."""
    return df.withColumn("_csv", F.from_csv(column, schema, {"sep": separator, "mode": "PERMISSIVE"})).select(*[c for c in df.columns if c != column], "_csv.*")


def columnar_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Parquet or ORC."""
    if kind not in ("parquet", "orc"):
        raise ValueError(f"unknown kind {kind}")
    return spark.read.format(kind).load(path)


def bar_messages(lines: DataFrame, text: str = "value") -> DataFrame:
    """Bars from texts that hold a JSON array of messages; only messages of type b count.

    Columns as in BAR_COLUMNS and bad, the text that could not be parsed (its other columns are null). Missing vwap and
    trade_count become 0.
    """
    parsed = F.from_json(text, "array<map<string,string>>", {"mode": "PERMISSIVE"})
    one = lines.withColumn("_m", parsed)
    spread = one.select(F.when(F.col("_m").isNull(), F.col(text)).alias("bad"), F.explode_outer("_m").alias("m"))
    kept = spread.where("bad is not null or m['T'] = 'b'")
    value = lambda k: F.col("m").getItem(k)
    cast = {"symbol": F.upper(F.trim(value("S"))), "timestamp": to_time(value("t"))}
    columns = [cast.get(name, to_number(value(field))).alias(name) for field, name in BAR_COLUMNS.items()]
    out = kept.select(*columns, "bad")
    for c in ("vwap", "trade_count"):
        out = out.withColumn(c, F.when(F.col("bad").isNull(), F.coalesce(c, F.lit(0.0))))
    return out
