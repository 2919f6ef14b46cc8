"""Best representative of each group of duplicate records."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def candidates(df: DataFrame, *, group: list[str], row_id: str, recency: list[Column], trust: Column, fields: dict[str, Column]) -> DataFrame:
    """Per group its size n and the array cands of the records that can't be left out, the newest first.

    A record is described by the set of fields it can serve (mask, its completeness), its trust (an int, larger is
    better) and its recency (compared in order, null first, then row_id). Of the records of one group with the same
    mask and trust only the newest is kept, before the shuffle: the others are below it and serve nothing more. So a
    group has at most 2 ** len(fields) candidates for each trust, however many records it has. fields gives for each
    name the value where it is usable and null where it isn't; at most 62 fields.

    layer is the dominance layer: 1 is the skyline (no record is at least as complete, trusted and recent), the next
    one what is undominated without it, and so on.
    """
    if len(fields) > 62:
        raise ValueError("at most 62 fields")
    mask = F.lit(0).cast("long")
    for i, value in enumerate(fields.values()):
        mask = mask + F.when(value.isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    order = [c.alias(f"r{i}") for i, c in enumerate(recency)]
    best = F.struct(*order, F.col(row_id).alias("row"), F.struct(*[v.alias(n) for n, v in fields.items()]).alias("values"))
    kept = (
        df.select(*group, mask.alias("_mask"), trust.cast("int").alias("_trust"), best.alias("_best"))
        .groupBy(*group, "_mask", "_trust")
        .agg(F.max("_best").alias("_best"), F.count("*").alias("_n"))
    )
    one = F.struct(F.col("_best").alias("best"), F.col("_trust").alias("trust"), F.col("_mask").alias("mask"))
    grouped = kept.groupBy(*group).agg(F.sum("_n").alias("n"), F.sort_array(F.collect_list(one), asc=False).alias("_all"))
    field = lambda name: F.transform("_all", lambda c: c[name])
    layered = grouped.withColumn("_layer", dominance_layers(field("mask"), field("trust")))
    both = F.zip_with("_all", "_layer", lambda c, n: F.struct(n.alias("layer"), c.trust.alias("trust"), c.best.alias("best"), c.mask.alias("mask")))
    return layered.withColumn("cands", both).drop("_all", "_layer")


def layers_of(masks: np.ndarray, trusts: np.ndarray) -> np.ndarray:
    """The dominance layer of each candidate, the most recent first: one more than the deepest of those above it.

    A candidate is above another if it comes before it, is trusted at least as much and serves every field that the
    other serves. One vector operation per candidate.
    """
    layers = np.ones(len(masks), np.int32)
    for i in range(1, len(masks)):
        above = ((masks[:i] & masks[i]) == masks[i]) & (trusts[:i] >= trusts[i])
        if above.any():
            layers[i] = layers[:i][above].max() + 1
    return layers


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def dominance_layers(masks: pd.Series, trusts: pd.Series) -> pd.Series:
    """layers_of for each group's arrays."""
    return pd.Series([layers_of(np.asarray(m, np.int64), np.asarray(t, np.int64)) for m, t in zip(masks, trusts)])


def winners(cands: DataFrame, fields: list[str], least_trust: int) -> DataFrame:
    """Adds win_<field>: the candidate (row, value) that serves the field, null where none does.

    Policy: candidates of at least least_trust, layer by layer, in each layer the most trusted and then the most recent
    first. The skyline's first record is the representative; a field it can't serve is filled from the rest of the skyline
    and then from the next layers. As completeness is compared field by field, a record that serves a field is only
    below records that serve it too, so among equally trusted ones the fill is the newest usable value.
    """
    ranked = _by_policy(F.filter("cands", lambda c: c.trust >= least_trust))
    out = cands.withColumn("_ranked", ranked)
    for i, name in enumerate(fields):
        able = F.filter("_ranked", _serves(1 << i))
        first = F.get(able, F.lit(0))
        out = out.withColumn(f"win_{name}", F.when(first.isNotNull(), F.struct(first.best.row.alias("row"), first.best["values"][name].alias("value"), first.layer.alias("layer"))))
    return out.drop("_ranked")


def _by_policy(cands: Column) -> Column:
    """Candidates by layer, then the most trusted, then the most recent."""
    keyed = F.transform(cands, lambda c: F.struct((-c.layer).alias("above"), c.trust.alias("trust"), c.best.alias("best"), c.mask.alias("mask"), c.layer.alias("layer")))
    return F.sort_array(keyed, asc=False)


def _serves(bit: int) -> Callable[[Column], Column]:
    return lambda c: c.mask.bitwiseAND(F.lit(bit).cast("long")) != 0


def representatives(df: DataFrame, *, group: list[str], row_id: str, recency: list[Column], trust: Column, fields: dict[str, Column], least_trust: int = 0) -> DataFrame:
    """One row per group: the group's columns, n, the representative's row_id, and each field from the record that serves it.

    Groups compare null as equal to null. A field that no record serves is null, row_id is null where no record is
    trusted enough. Repeated rows count in n and change nothing else. Columns of df that aren't named are ignored. An
    empty df gives no rows.
    """
    names = list(fields)
    w = winners(candidates(df, group=group, row_id=row_id, recency=recency, trust=trust, fields=fields), names, least_trust)
    skyline = _by_policy(F.filter("cands", lambda c: (c.layer == 1) & (c.trust >= least_trust)))
    return w.select(*group, "n", F.get(skyline, F.lit(0)).best.row.alias(row_id), F.size(skyline).alias("skyline_size"), *[F.col(f"win_{n}.value").alias(n) for n in names])
