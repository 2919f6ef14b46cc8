"""Universes: lists of symbols from a file or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import symbol


def universe_table(symbols: DataFrame) -> DataFrame:
    """The distinct symbols of a column symbol, in capitals without outer blanks; nulls and blanks are left out."""
    return symbols.select(symbol("symbol").alias("symbol")).where("symbol <> ''").distinct()


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A universe from a text file: symbols divided by commas, blanks or lines, with an optional list mark; what follows a # is a remark."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"#.*$", "").alias("line")).where(~F.col("line").rlike(r"^\s*[\w ]+:\s*$"))
    words = lines.select(F.explode(F.split("line", r"[,\s\[\]]+")).alias("symbol")).where("symbol not in ('', '-')")
    return universe_table(words.select(F.regexp_replace("symbol", "[\"']", "").alias("symbol")))
