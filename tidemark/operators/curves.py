"""Vulnerability curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unpivoted(table: DataFrame, depth: str) -> DataFrame:
    """(fn, depth, fraction) from one column for each curve."""
    names = [c for c in table.columns if c != depth]
    pairs = F.array(*[F.struct(F.lit(c).alias("fn"), F.col(f"`{c}`").cast("double").alias("fraction")) for c in names])
    return table.select(F.col(f"`{depth}`").cast("double").alias("depth"), F.explode(pairs).alias("c")).select("c.fn", "depth", "c.fraction")


def densified(curves: DataFrame, decimals: int = 2) -> DataFrame:
    """(fn, bin, fraction): linear interpolation of (fn, depth, fraction) on the lattice of 10^-decimals, keyed by the integer bin."""
    scale = float(10**decimals)
    w = W.partitionBy("fn").orderBy("depth")
    b = F.floor(F.col("depth") * scale + 0.5).cast("int")
    seg = curves.withColumns({"b0": b, "b1": F.lead(b).over(w), "d1": F.lead("depth").over(w), "f1": F.lead("fraction").over(w)})
    last = F.when(F.col("b1").isNull(), F.col("b0")).otherwise(F.col("b1") - 1)
    seg = seg.where("b1 IS NULL OR b1 > b0").withColumn("bin", F.explode(F.sequence("b0", last)))
    at = F.col("bin").cast("double") / scale
    line = F.col("fraction") + (F.col("f1") - F.col("fraction")) * (at - F.col("depth")) / (F.col("d1") - F.col("depth"))
    return seg.select("fn", "bin", F.when(F.col("b1").isNull() | (F.col("bin") == F.col("b0")), F.col("fraction")).otherwise(line).alias("fraction"))


def bounds(dense: DataFrame) -> DataFrame:
    """(fn, bin_min, bin_max) of densified curves."""
    return dense.groupBy("fn").agg(F.min("bin").alias("bin_min"), F.max("bin").alias("bin_max"))
