"""Features by name: how each is built, how far it looks back, and sets of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.series import log_return, rolling
from tidewell.plans.base import by_symbol


@dataclass(frozen=True)
class Feature:
    name: str
    lookback: int
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class FeatureSet:
    name: str
    features: tuple[str, ...]
    version: str = "1"
    parameters: dict = field(default_factory=dict, hash=False)

    def config_hash(self) -> str:
        text = json.dumps({"name": self.name, "features": list(self.features), "version": self.version, "parameters": self.parameters}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


FEATURES: dict[str, Feature] = {}


def feature(name: str, lookback: int, needs: tuple[str, ...] = ()) -> Callable:
    """Register a builder of a column over a symbol's bars in order; needs names features it uses."""

    def add(build: Callable[[], Column]) -> Callable[[], Column]:
        if name in FEATURES:
            raise ValueError(f"{name} is registered already")
        FEATURES[name] = Feature(name, lookback, build, needs)
        return build

    return add


for _k in (1, 5, 21):
    feature(f"ret_{_k}d", _k)(lambda k=_k: log_return("close", by_symbol(), k))
feature("mom_3m", 63)(lambda: log_return("close", by_symbol(), 63))
for _n in (21, 63):
    feature(f"rv_{_n}d", _n + 1, ("ret_1d",))(lambda n=_n: rolling(F.stddev_samp("ret_1d"), by_symbol(), n, "ret_1d") * F.sqrt(F.lit(252)))
feature("dist_20d_high", 20)(lambda: F.col("close") / rolling(F.max("close"), by_symbol(), 20, "close") - 1)
feature("dist_20d_low", 20)(lambda: F.col("close") / rolling(F.min("close"), by_symbol(), 20, "close") - 1)


def lookback(names: list[str] | tuple[str, ...]) -> int:
    """Rows that the features look back on at most."""
    return max((FEATURES[n].lookback for n in names), default=0)


def compute(bars: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """symbol, timestamp and the named features over bars; all share one partitioning and order."""
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise KeyError(f"unknown features: {', '.join(unknown)}")
    out, made = bars.select("symbol", "timestamp", "close"), set()
    for n in names:
        for m in (*FEATURES[n].needs, n):
            if m not in made:
                out = out.withColumn(m, FEATURES[m].build())
                made.add(m)
    return out.select("symbol", "timestamp", *names)
