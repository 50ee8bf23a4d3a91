"""Damage of objects and cells from depth and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import depth_bin, rounded
from .curves import bounds

#: Most rows of densified curves that are broadcast; beyond it the join is exchanged.
BROADCAST_CURVES = 2_000_000


def with_fraction(df: DataFrame, dense: DataFrame, depth: Column, fn: str = "fn", decimals: int = 2) -> DataFrame:
    """Adds `fraction`: the curve's value at the depth, clamped to the curve's range; NULL for a NULL depth or an unknown curve."""
    ranges = bounds(dense)
    ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_CURVES else ranges
    side = F.broadcast(dense) if dense.count() <= BROADCAST_CURVES else dense
    keyed = df.join(ranges.withColumnRenamed("fn", "_fn"), F.col(fn) == F.col("_fn"), "left").drop("_fn")
    bin_ = F.when(depth.isNotNull() & F.col("bin_min").isNotNull(), F.greatest(F.least(depth_bin(depth, decimals), F.col("bin_max")), F.col("bin_min")))
    keyed = keyed.withColumn("_bin", bin_).drop("bin_min", "bin_max")
    return keyed.join(side.select(F.col("fn").alias("_fn"), F.col("bin").alias("_b"), "fraction"), (F.col(fn) == F.col("_fn")) & (F.col("_bin") == F.col("_b")), "left").drop("_fn", "_b", "_bin")


def component_rows(assets: DataFrame, components: dict[str, dict[str, str]], keep: list[str]) -> DataFrame:
    """keep, component, fn, max: a row for each component that an asset has columns for."""
    pairs = F.array(*[F.struct(F.lit(name).alias("component"), F.col(c["fn"]).alias("fn"), F.col(c["max"]).cast("double").alias("max")) for name, c in components.items()])
    return assets.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.component", "p.fn", "p.max")


def damages(rows: DataFrame, dense: DataFrame, decimals: int = 2) -> DataFrame:
    """Adds `damage` to rows with fn, max, inun_depth, red_fact: fraction * max * red_fact, to cents."""
    out = with_fraction(rows, dense, F.col("inun_depth"), "fn", decimals)
    return out.withColumn("damage", rounded(F.col("fraction") * F.col("max") * F.col("red_fact"))).drop("fraction")
