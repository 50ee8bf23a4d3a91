"""Grids against grids: cell damage, totals, expected damage, nearest resampling, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from .damage import with_fraction
from .overlay import Grid, corner_of, inside, pixel_of


def cell_damage(exposure: DataFrame, hazard: DataFrame, dense: DataFrame, decimals: int = 2) -> DataFrame:
    """exp_band, haz_band, row, col, damage from exposure (band, row, col, value, fn) and hazard (band, row, col, value): value * fraction of the depth, where both have data."""
    e = exposure.where("value IS NOT NULL").select(F.col("band").alias("exp_band"), "row", "col", F.col("value").alias("exposed"), "fn")
    h = hazard.where("value IS NOT NULL").select(F.col("band").alias("haz_band"), "row", "col", F.col("value").alias("depth"))
    out = with_fraction(e.join(h, ["row", "col"]), dense, F.col("depth"), "fn", decimals)
    return out.select("exp_band", "haz_band", "row", "col", (F.col("exposed") * F.col("fraction")).alias("damage"))


def cell_totals(damage: DataFrame) -> DataFrame:
    """haz_band, row, col, total over the exposure bands, as a sum of millionths; cells without data have no row."""
    unit = F.floor(F.col("damage") * 1e6 + 0.5).cast("long")
    return damage.where("damage IS NOT NULL").groupBy("haz_band", "row", "col").agg((F.sum(unit).cast("double") / 1e6).alias("total"))


def cell_risk(totals: DataFrame, weights: dict[int, float]) -> DataFrame:
    """row, col, ead from haz_band, row, col, total and the weight of each band; a band without data counts as none."""
    at = lambda b: F.max(F.when(F.col("haz_band") == b, F.col("total")))
    df = totals.groupBy("row", "col").agg(*[at(b).alias(f"b{b}") for b in weights])
    ead = F.lit(0.0)
    for b, w in weights.items():
        ead = ead + F.lit(w) * F.coalesce(F.col(f"b{b}"), F.lit(0.0))
    return df.select("row", "col", ead.alias("ead"))


def resampled(cells: DataFrame, src: Grid, dst: Grid) -> DataFrame:
    """Cells (band, row, col, value) of dst, each with the value of the src cell its centre lies in; where dst is finer an src cell fans out, so work follows the output."""
    if src.srs != dst.srs:
        raise DataError(f"grids in {src.srs} and {dst.srs}: reproject first")
    spark = cells.sparkSession
    target = spark.range(dst.height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(dst.width - 1))).alias("col"))
    x, y = corner_of(dst, F.col("col") + 0.5, F.col("row") + 0.5)
    col, row = pixel_of(src, x, y)
    target = target.withColumn("_c", col).withColumn("_r", row).where(inside(src, F.col("_c"), F.col("_r")))
    source = cells.select("band", F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return target.join(source, ["_r", "_c"]).select("band", "row", "col", "value")


def same_grid(a: Grid, b: Grid) -> bool:
    """Equal system, shape and transform to two decimals."""
    near = lambda g: tuple(round(v, 2) for v in (g.x0, g.dx, g.y0, g.dy))
    return a.srs == b.srs and (a.width, a.height) == (b.width, b.height) and near(a) == near(b)


def aligned(exposure: DataFrame, exp: Grid, hazard: DataFrame, haz: Grid, prefer: str = "exposure") -> tuple[DataFrame, DataFrame, Grid]:
    """Both on one grid: the preferred one stays, the other is resampled."""
    if prefer not in ("exposure", "hazard"):
        raise DataError(f"unknown preference {prefer!r}")
    if same_grid(exp, haz):
        return exposure, hazard, exp
    if prefer == "exposure":
        return exposure, resampled(hazard, haz, exp), exp
    fns = exposure.select("band", "fn").distinct()
    return resampled(exposure, exp, haz).join(F.broadcast(fns), "band"), hazard, haz


def tiles(width: int, height: int, tile_w: int, tile_h: int) -> list[tuple[int, int, int, int]]:
    """(col, row, width, height) of the windows that cover a grid; the last ones are smaller."""
    return [(c, r, min(tile_w, width - c), min(tile_h, height - r)) for r in range(0, height, tile_h) for c in range(0, width, tile_w)]


def ranges(length: int, parts: int) -> list[tuple[int, int]]:
    """1-based inclusive ranges that cut a length into parts of nearly equal size."""
    size = -(-length // parts) if parts else 0
    return [(i + 1, min(i + size, length)) for i in range(0, length, size)] if size else []
