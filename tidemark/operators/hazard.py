"""Hazard values of objects: wet cells, mean or largest depth, reduction factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell is wet above this depth.
WET = 0.0001


def elevation(reference: str, ground: Column) -> Column:
    """What the water level is measured from: the ground level for `datum`, else nothing; a missing level counts as 0."""
    return F.coalesce(ground, F.lit(0.0)) if reference.lower() == "datum" else F.lit(0.0)


def fixed_point_mean(x: Column, digits: int = 6) -> Column:
    """Mean as an integer sum: the same in any order of summation, and with partial sums before the exchange."""
    scale = 10**digits
    return F.sum(F.floor(x * float(scale) + 0.5).cast("long")).cast("double") / (F.count(x).cast("double") * float(scale))


def object_hazard(sampled: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
    """keys, inun_depth, red_fact from rows (keys, value, ground, ground_flht): one row for each cell of an object and band, value NULL for no data.

    Depth is taken over wet cells, less the floor height, and may be negative; red_fact is the share of wet cells, 1 for `max`; an
    object without wet cells has NULL depth, one without cells also a NULL red_fact.
    """
    level = F.col("value") - F.col("ground")
    wet = F.when(level > WET, level)
    depth = fixed_point_mean(wet) if method == "mean" else F.max(wet)
    n_all = F.count(F.col("cell"))
    share = F.when(n_all > 0, F.count(wet).cast("double") / n_all.cast("double")) if method == "mean" else F.when(n_all > 0, F.lit(1.0))
    out = sampled.groupBy(*keys).agg(depth.alias("_d"), share.alias("red_fact"), F.first("ground_flht").alias("_f"))
    return out.select(*keys, (F.col("_d") - F.col("_f")).alias("inun_depth"), "red_fact")


def list_hazard(values: Column, ground: Column, ground_flht: Column, method: str = "mean") -> tuple[Column, Column]:
    """(depth, red_fact) for an array of cell values, within the row; sums in the array's order."""
    wet = F.filter(F.transform(values, lambda v: v - ground), lambda v: v.isNotNull() & ~F.isnan(v) & (v > WET))
    if method == "max":
        return F.array_max(wet) - ground_flht, F.when(F.size(values) > 0, F.lit(1.0))
    total = F.aggregate(wet, F.lit(0.0), lambda a, v: a + v)
    depth = F.when(F.size(wet) > 0, total / F.size(wet)) - ground_flht
    return depth, F.when(F.size(values) > 0, F.size(wet).cast("double") / F.size(values).cast("double"))
