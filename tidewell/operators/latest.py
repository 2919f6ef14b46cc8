"""The latest row per key, upserts and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """One whole row of df per by: the one with the greatest order columns, nulls lowest.

    Aggregates before the shuffle, so a key's many versions never meet in one task. Null keys are a key. Rows
    equal in all order columns: any of them, so order should end in a unique column.
    """
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """existing with incoming merged in by key: of equal keys the row with the greatest order columns, incoming on ties. Idempotent."""
    tagged = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return latest(tagged, by=by, order=[*order, "_side"]).drop("_side")


def preserving(df: DataFrame, *, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Like latest, but each column of keep is the latest that isn't null."""
    rank = F.struct(*order)
    rest = [c for c in df.columns if c not in by and c not in keep]
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in keep]
    out = df.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("_best"), *kept)
    return out.select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest], *keep).select(*df.columns)


def compare(left: DataFrame, right: DataFrame, *, by: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Keys on one side only or whose columns differ by more than their tolerance: by, kind, and both values of each column."""
    names = list(tolerances)
    a = left.select(*by, *[F.col(c).alias(f"left_{c}") for c in names], F.lit(True).alias("_l"))
    b = right.select(*by, *[F.col(c).alias(f"right_{c}") for c in names], F.lit(True).alias("_r"))
    both = a.join(b, by, "full_outer")
    off: Column = F.lit(False)
    for c, most in tolerances.items():
        off = off | F.coalesce(F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) > most, F.col(f"left_{c}").isNull() != F.col(f"right_{c}").isNull())
    kind = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(off, "differs")
    return both.withColumn("kind", kind).where("kind is not null").drop("_l", "_r")


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's columns in their order, doubles to 8 places; nulls are told from empty strings."""
    types = dict(df.dtypes)
    text = lambda c: (F.col(c).cast("decimal(38,8)") if types[c] in ("double", "float") else F.col(c)).cast("string")
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(text(c), F.lit("\\N")) for c in columns]), 256)


def set_hash(hashes: Column | str) -> Column:
    """An aggregate: one hash of a group's row hashes, whatever their order; sums of 32-bit parts, so no list is gathered."""
    h = F.col(hashes) if isinstance(hashes, str) else hashes
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(",", *parts, F.count(h).cast("string")), 256)
