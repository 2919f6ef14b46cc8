"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_240_613
#: Rows of one source and length that one task ranks in a balanced draw.
RANKED_ROWS = 50_000
#: A draw has so many equally likely values.
DRAWS = 1 << 53


@dataclass
class Rate:
    source: str
    share: float
    most: int
    tokens: int
    rate: float
    squares: float = 0.0
    documents: int = 0

    @property
    def whole(self) -> int:
        return int(self.rate + 1e-9)

    @property
    def fraction(self) -> float:
        return max(0.0, self.rate - self.whole)


def rates(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[Rate]:
    """The repetition rate of each target's source; as many as there are targets.

    Shares are taken relative to their sum over sources that hold tokens; repeated targets of a source add up (the
    least of their limits holds); targets that are null or not above 0 are left out. Without total_tokens the mix is as large as
    the shares allow: the source that its limit binds first is used as often as it may be. A larger total_tokens is
    cut to that size, so no source is used more often than its limit.
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most"))
    size = F.col("n_tokens").cast("double")
    held = tokens.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(size * size).alias("squares"), F.count("*").alias("documents"))
    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = wanted.join(held, "source", "left").select("source", "share", "most", some("tokens"), some("squares"), some("documents")).collect()
    whole = sum(r["share"] for r in rows if r["tokens"] > 0)
    size = min((r["most"] * r["tokens"] * whole / r["share"] for r in rows if r["tokens"] > 0), default=0.0)
    if total_tokens is not None:
        size = min(size, total_tokens)
    return [
        Rate(r["source"], r["share"], r["most"], r["tokens"], min(float(r["most"]), size * r["share"] / whole / r["tokens"]) if r["tokens"] > 0 else 0.0, float(r["squares"]), r["documents"])
        for r in sorted(rows, key=lambda r: r["source"])
    ]


def _draw(row_id: str, seed: int) -> Column:
    """A number from 0 to 1 (without 1) that depends on the row's id and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(DRAWS)) / F.lit(float(DRAWS))


def _table(spark, found: list[Rate]) -> DataFrame:
    """One row per target: so few that the optimizer sends them out whole, and that it may join them as it likes if not."""
    rows = [(r.source, r.whole, float(r.fraction), r.documents) for r in found if r.rate > 0]
    return spark.createDataFrame(rows, "source string, _whole int, _fraction double, _documents long")


def mix(tokens: DataFrame, found: list[Rate], *, row_id: str, seed: int = SEED, balanced: bool = False) -> DataFrame:
    """Every copy of every document in the mix: row_id, source, copy_no (from 1), n_tokens.

    A document is used floor(rate) times, and once more if its hash-seeded draw lies below the fraction: never more
    often than its source's limit, and the same on every run. Draws of different documents are independent, so a source's
    share is met on average, with the deviation that shares reports: large where a few long documents hold much of a small source.

    balanced draws the one more copy with the same probability for every document, whatever its length, but
    not independently: a source's documents are ordered by length and then by hash, and one is taken each time that the
    sum of fractions passes a whole number, counted from a start drawn from the seed. A source then misses its share by
    about one document's tokens. Ranks come from buckets small enough for a task.

    Documents of a null source or of one without a target, and those whose row_id is null, are left out. Rows that repeat
    a row_id share their independent draw; in a balanced draw each is a document of its own. Null and negative sizes are
    kept as they are. Empty input gives no rows.
    """
    known = tokens.where(F.col(row_id).isNotNull()).select(row_id, "source", "n_tokens").join(_table(tokens.sparkSession, found), "source")
    once_more = _systematic(known, row_id, seed, found) if balanced else known.withColumn("_more", (_draw(row_id, seed) < F.col("_fraction")).cast("int"))
    used = once_more.withColumn("_copies", F.col("_whole") + F.col("_more")).where("_copies > 0")
    return used.select(row_id, "source", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"), "n_tokens")


def _systematic(known: DataFrame, row_id: str, seed: int, found: list[Rate]) -> DataFrame:
    """known with _more: 1 where the sum of fractions, over the source's documents by length and hash, passes a whole number."""
    buckets = max([-(-r.documents // RANKED_ROWS) for r in found], default=1) or 1
    size = F.coalesce(F.col("n_tokens"), F.lit(0))
    hashed = F.xxhash64(F.lit(seed), F.col(row_id))
    placed = known.withColumn("_size", size).withColumn("_hash", hashed).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)).cast("int"))
    keys = ["source", "_size", "_bucket"]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", row_id)) - 1
    counts = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    per_size = counts.groupBy("source", "_size").agg(F.sum("_n").alias("_m"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("_shorter", F.coalesce(F.sum("_m").over(earlier("source", "_size")), F.lit(0))).drop("_m")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier("source", "_size", "_bucket")), F.lit(0))).drop("_n")
    ranked = placed.withColumn("_local", local).join(counts.join(per_size, ["source", "_size"]), keys)
    rank = F.col("_shorter") + F.col("_before") + F.col("_local")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(DRAWS)) / F.lit(float(DRAWS))
    passed = F.floor((rank + 1) * F.col("_fraction") + start) - F.floor(rank * F.col("_fraction") + start)
    return ranked.withColumn("_more", passed.cast("int"))


def shares(mixed: DataFrame, found: list[Rate]) -> DataFrame:
    """Per target source: target_share, max_repeats, tokens_available, rate, tokens_expected, expected_deviation, tokens_used, documents_used, actual_share, deviation.

    expected_deviation is the standard deviation of tokens_used under independent draws; deviation is actual_share less
    target_share, the latter relative to the sum over sources that hold tokens.
    """
    spark = mixed.sparkSession
    whole = sum(r.share for r in found if r.tokens > 0) or 1.0
    rows = [(r.source, r.share, r.share / whole if r.tokens > 0 else 0.0, r.most, r.tokens, r.rate, r.rate * r.tokens, (r.fraction * (1 - r.fraction) * r.squares) ** 0.5) for r in found]
    plan = spark.createDataFrame(rows, "source string, target_share double, _aim double, max_repeats int, tokens_available long, rate double, tokens_expected double, expected_deviation double")
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("documents_used"))
    joined = plan.join(used, "source", "left").select(*plan.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens_used", "documents_used")])
    told = joined.withColumn("actual_share", F.coalesce(F.try_divide("tokens_used", F.sum("tokens_used").over(Window.partitionBy())), F.lit(0.0)))
    return told.withColumn("deviation", F.col("actual_share") - F.col("_aim")).drop("_aim")
