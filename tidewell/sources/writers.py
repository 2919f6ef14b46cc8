"""Writers that can be repeated: a second run of the same rows leaves the table as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.latest import upsert
from tidewell.session import cut


def exists(spark, path: str) -> bool:
    """Whether a table's folder is there, on any file system."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge_table(incoming: DataFrame, path: str, *, by: list[str], order: list[str], partition: str) -> int:
    """Merge rows into a partitioned Parquet table by key; only the partitions that incoming touches are read and replaced.

    Returns the number of touched partitions. Of rows with the same key the one with the greatest order columns stays,
    the incoming one on ties. partition must be a function of the key, so that a key never moves.
    """
    spark = incoming.sparkSession
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    if not touched:
        return 0
    there = exists(spark, path)
    held = spark.read.parquet(path).where(F.col(partition).isin(touched)).select(*incoming.columns) if there else incoming.limit(0)
    merged = upsert(held, incoming, by=by, order=order)
    merged = cut(merged) if there else merged
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return len(touched)


def append_log(rows: DataFrame, path: str, batch: int | str) -> None:
    """Write the rows of a batch as JSON lines under batch=...; a batch that is repeated replaces its own rows and no others."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def write_artifact(rows: DataFrame, path: str) -> None:
    """Few rows as one JSON file of lines in a folder of its own, replaced as a whole."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def already_written(log: DataFrame, run_id: str, domain: str) -> bool:
    """Whether a log of runs (run_id, domain) holds this run: a writer then has nothing to do."""
    return not log.where((F.col("run_id") == run_id) & (F.col("domain") == domain)).limit(1).isEmpty()
