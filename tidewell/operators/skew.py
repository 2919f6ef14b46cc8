"""Joins and batches that keep their size when a few keys hold much of the data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may hold; a key of more is spread over several.
ROWS_PER_TASK = 250_000
#: Rows of a null key match nothing and are spread over so many tasks.
NULL_SALTS = 1024


def hot_keys(df: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """The values of key with more rows than a task may hold, and over how many tasks to spread each: key, _tw_salts.

    There are at most rows / rows_per_task of them, so the table can be sent to every task: at a trillion rows of df a few dozen MB.
    """
    rows = float(rows_per_task or ROWS_PER_TASK)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_tw_n"))
    return counts.where(F.col("_tw_n") > rows).select(key, F.ceil(F.col("_tw_n") / rows).cast("int").alias("_tw_salts"))


def join_spread(left: DataFrame, right: DataFrame, *, on: list[str], key: str, spread: str, how: str = "inner", rows_per_task: int | None = None) -> DataFrame:
    """left joined with right on the columns on, where rows of left with a hot value of key are spread over several tasks.

    spread is a column of left whose hash picks the task. right holds one row or few per value of on; only its rows of
    hot keys are repeated. how is inner or left. Null keys match nothing, as in SQL. left's keys are counted
    once, by an aggregate within the same plan; no job runs before the query does.
    """
    salt = "_tw_salt"
    hot = F.broadcast(hot_keys(left, key, rows_per_task))
    salts = F.coalesce("_tw_salts", F.lit(1))
    tasks = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(salts)
    lefts = left.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(spread), tasks).cast("int")).drop("_tw_salts")
    rights = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1))).drop("_tw_salts")
    return lefts.join(rights, [*on, salt], how).drop(salt)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df hash-partitioned by columns into a number of tasks that stays: small partitions aren't merged, as what follows is more work than its bytes tell."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *columns)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of about rows rows that never divide a group; the input must be sorted by keys."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        size += len(f)
        if size < rows:
            continue
        all_rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        same = (all_rows[keys] == all_rows[keys].iloc[-1]).all(axis=1).to_numpy()
        start = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if start:
            yield all_rows.iloc[:start].reset_index(drop=True)
        held = [all_rows.iloc[start:]]
        size = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)
