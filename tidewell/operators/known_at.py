"""Attributes as known at event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.persistent_tree import latest_known
from tidewell.operators.skew import join_spread, whole_groups

SHARD_DAYS = 28
#: A shard of more rows and events than this is divided into shorter ones.
SHARD_ROWS = 200_000
BATCH_ROWS = 100_000
#: More parts than one shard is ever divided into; each part of a shard has a number below it.
PARTS = 1 << 20
LEAST = -(2**63)


def known_at(
    events: DataFrame, attributes: DataFrame, *, by: str, at: str, valid: str, ingested: str, row_id: str, carry: list[str] | None = None, as_of: str | None = None,
    shard_days: int = SHARD_DAYS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """For each distinct (by, at, as_of) of events the newest attribute row known then: columns by, at, as_of, row_id and carry.

    A row is known at a time if neither its valid nor its ingested time is later than at; a null ingested time sets no bound. Newest
    is the latest valid, then the latest ingested (null is the earliest), then the largest row_id. as_of names a column of
    events with a time of its own: what was known at the time at about the time as_of, so rows valid later than as_of take no
    part, corrections of the past that had arrived by at do. Without as_of it is at; a later as_of counts as at. Rows with a null by or
    valid, and events with a null by, at or as_of, take no part. An event that knows no row is absent. Of rows that repeat, one
    counts. Other columns of either side, whatever their names, are ignored. Empty sides give an empty result.

    Time is cut into shards of shard_days, and shards of an entity that hold more than shard_rows into shorter ones. An
    event belongs to the shard of its as_of. A row belongs to the shard in which it became known and, with as_of, to all from
    its valid time on: in those it may still be unknown. A shard starts from the one row that its past leaves: all rows known
    before it are valid before it, so only the newest of them can still be seen. Rows are reduced to one for each
    (known, valid) before the shuffle. Each task builds path-copied persistent search trees over its shards; an event takes
    the root of its known time and searches the valid times.
    """
    carry = list(carry or [])
    width = shard_days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shard_of = lambda c: F.floor(F.col(c) / width)
    probes = (
        events.select(F.col(by).alias("entity"), micros(at).alias("t"), micros(as_of or at).alias("asked"))
        .where("entity is not null and t is not null and asked is not null")
        .distinct()
        .withColumn("v", F.least("asked", "t"))
        .withColumn("shard", shard_of("v"))
    )
    known = F.greatest(micros(valid), F.coalesce(micros(ingested), micros(valid)))
    newest = F.max(F.struct(micros(ingested).alias("ingested"), F.col(row_id).cast("long").alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]))
    rows = (
        attributes.where(F.col(by).isNotNull() & F.col(valid).isNotNull() & F.col(row_id).isNotNull())
        .groupBy(F.col(by).alias("entity"), known.alias("t"), micros(valid).alias("valid"))
        .agg(newest.alias("best"))
        .withColumn("last", shard_of("t"))
    )
    first = shard_of("valid") if as_of else F.col("last")
    rows = rows.withColumn("first", first).withColumn("shard", F.explode(F.sequence("first", "last")))

    # Shards that hold too much, and into how many parts each is divided: at most as many as all rows / shard_rows.
    # Counted before repeats are taken out, which is cheaper and can only divide a shard further.
    raw = attributes.where(F.col(by).isNotNull() & F.col(valid).isNotNull()).select(F.col(by).alias("entity"), F.floor(known / width).alias("last"), F.floor(micros(valid) / width).alias("first"))
    raw = raw.select("entity", F.explode(F.sequence("first", "last")).alias("shard")) if as_of else raw.select("entity", F.col("last").alias("shard"))
    asks = events.select(F.col(by).alias("entity"), F.floor(F.least(micros(as_of or at), micros(at)) / width).alias("shard"))
    counted = lambda df: df.groupBy("entity", "shard").agg(F.count("*").alias("n"))
    held = counted(raw).unionByName(counted(asks))
    parts = held.groupBy("entity", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > shard_rows)
    parts = F.broadcast(parts.select("entity", "shard", F.least(F.ceil(F.col("n") * 4 / shard_rows), F.lit(PARTS - 1)).cast("long").alias("parts")))
    several = F.coalesce("parts", F.lit(1).cast("long"))
    part = lambda c: F.floor((F.col(c) - F.col("shard") * width) / width * several)
    number = lambda p: F.col("shard") * PARTS + p
    probes = probes.join(parts, ["entity", "shard"], "left").select("entity", "t", "v", "asked", number(part("v")).alias("shard"))
    from_ = F.when(F.col("shard") == shard_of("valid"), part("valid")).otherwise(F.lit(0).cast("long")) if as_of else part("t")
    to = F.when(F.col("shard") == F.col("last"), part("t")).otherwise(several - 1)
    placed = rows.join(parts, ["entity", "shard"], "left").withColumn("from", from_).withColumn("to", to).withColumn("in", F.explode(F.sequence("from", "to")))
    placed = placed.select("entity", number(F.col("in")).alias("shard"), "t", "valid", "best", ((F.col("shard") == F.col("last")) & (F.col("in") == F.col("to"))).alias("is_last"))

    one = T.StructType([T.StructField("valid", T.LongType()), T.StructField("best", rows.schema["best"].dataType)])
    told = placed.where("is_last").groupBy("entity", "shard").agg(F.max(F.struct("valid", "best")).alias("best"), F.lit(False).alias("is_asked"))
    wanted = probes.groupBy("entity", "shard").agg(F.lit(None).cast(one).alias("best"), F.lit(True).alias("is_asked"))
    summary = told.unionByName(wanted).groupBy("entity", "shard").agg(F.max("best").alias("best"), F.max("is_asked").alias("is_asked"))
    before = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    past = (
        summary.withColumn("past", F.max("best").over(before))
        .where("is_asked and past is not null")
        .select("entity", "shard", F.lit(LEAST // 2).alias("t"), F.col("past.valid").alias("valid"), F.col("past.best").alias("best"))
    )
    items = placed.drop("is_last").unionByName(past)
    ingested_at = F.coalesce(F.col("best.ingested"), F.lit(LEAST)).alias("ingested")
    flat = items.select("entity", "shard", "t", "valid", ingested_at, F.col("best.row").alias("row"), F.lit(0).cast("long").alias("asked"), F.lit(True).alias("is_item"), *[F.col(f"best.c{i}").alias(f"c{i}") for i in range(len(carry))])
    zero = F.lit(0).cast("long")
    asked = probes.select("entity", "shard", "t", F.col("v").alias("valid"), zero.alias("ingested"), zero.alias("row"), "asked", F.lit(False).alias("is_item"))
    both = flat.unionByName(asked, allowMissingColumns=True).repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    names = [f"c{i}" for i in range(len(carry))]
    schema = T.StructType([T.StructField("entity", both.schema["entity"].dataType), T.StructField("t", T.LongType()), T.StructField("asked", T.LongType()), T.StructField("row", T.LongType()), *[both.schema[n] for n in names]])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["entity", "shard"], BATCH_ROWS):
            is_item = f["is_item"].to_numpy(bool)
            shard = f.groupby(["entity", "shard"], sort=False).ngroup().to_numpy()
            i, p = f[is_item], f[~is_item]
            if not len(i) or not len(p):
                continue
            at_item = {c: i[c].to_numpy(np.int64) for c in ("t", "valid", "ingested", "row")}
            t, v = p["t"].to_numpy(np.int64), p["valid"].to_numpy(np.int64)
            seen = latest_known(shard[is_item], at_item["t"], at_item["valid"], (at_item["ingested"], at_item["row"]), shard[~is_item], t, v)
            hit = seen >= 0
            out = i[["row", *names]].iloc[seen[hit]].reset_index(drop=True)
            out.insert(0, "asked", p["asked"].to_numpy(np.int64)[hit])
            out.insert(0, "t", t[hit])
            out.insert(0, "entity", p["entity"].to_numpy()[hit])
            yield out

    found = both.mapInPandas(search, schema)
    when = [F.timestamp_micros("t").alias(at), *([F.timestamp_micros("asked").alias(as_of)] if as_of else [])]
    return found.select(F.col("entity").alias(by), *when, F.col("row").alias(row_id), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def join_known(events: DataFrame, found: DataFrame, *, by: str, at: str, spread: str, how: str = "inner", as_of: str | None = None) -> DataFrame:
    """The rows of events with what known_at found for their (by, at, as_of); rows of hot entities are spread by the column spread."""
    return join_spread(events, found, on=[by, at, *([as_of] if as_of else [])], key=by, spread=spread, how=how)
