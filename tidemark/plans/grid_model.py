"""Raster model: exposure grids on hazard grids to cell damage, totals and expected annual damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import risk_weights
from ..operators import curves, grids
from ..operators.overlay import Grid
from ..sources import rasters, tables
from . import checks
from .config import Config, table_decimals

MANDATORY = ("hazard.file", "vulnerability.file", "exposure.grid.file")


def impact(exposure: DataFrame, hazard: DataFrame, dense: DataFrame, periods: list[float] | None = None, decimals: int = 2) -> dict[str, DataFrame]:
    """damage, total and, with return periods, ead; exposure holds (band, row, col, value, fn)."""
    damage = grids.cell_damage(exposure, hazard, dense, decimals)
    total = grids.cell_totals(damage)
    out = {"damage": damage, "total": total}
    if periods:
        out["ead"] = grids.cell_risk(total, dict(enumerate(risk_weights(periods), 1)))
    return out


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    checks.entries(config.keys(), MANDATORY)
    checks.existing_entries(config, MANDATORY)
    hazard = rasters.read_raster(spark, config.path("hazard.file"), config.get("hazard.srs"))
    exposure = rasters.read_raster(spark, config.path("exposure.grid.file"), config.get("exposure.grid.srs"))
    table = tables.read_csv(spark, config.path("vulnerability.file"), str(config.get("vulnerability.csv.sep", ",")))
    depth = str(config.get("vulnerability.csv.index", "water depth"))
    decimals = table_decimals(config)
    dense = curves.densified(curves.unpivoted(table.df, depth), decimals).cache()
    # a grid without metadata, such as an ASCII one, takes its curves from the settings
    given = config.get("exposure.grid.fn_damage")
    fns = [str(f) for f in (given if isinstance(given, list) else [given])] if given else [exposure.item(i + 1, "fn_damage") for i in range(len(exposure.meta))]
    checks.grid_curves(fns, [c for c in table.df.columns if c != depth])
    named = exposure.cells.withColumn("fn", F.get(F.array(*map(F.lit, fns)), F.col("band") - 1))
    risk = bool(config.get("model.risk", False))
    periods = checks.return_periods([m.get("return_period") for m in hazard.meta], config.get("hazard.return_periods"), config["hazard.file"]) if risk else None
    cells, water, grid = grids.aligned(named, exposure.grid, hazard.cells, hazard.grid, str(config.get("model.grid.prefer", "exposure")))
    out = impact(cells, water, dense, periods, decimals)
    bands = checks.band_names(hazard.names or [""] * len(hazard.meta), risk, periods)
    for name, raster in rastered(out, grid, bands, fns).items():
        rasters.write_raster(raster, f"{config.output}/{name}.parquet")
    return out


def rastered(out: dict[str, DataFrame], grid: Grid, bands: list[str], fns: list[str]) -> dict[str, rasters.Raster]:
    """The results as grids that can be read back: a band for each hazard band and exposure band, for each hazard band, and one for the risk."""
    n = len(fns)
    pairs = [(b, f) for b in bands for f in fns]
    made = {
        "damage": rasters.Raster(out["damage"].select((F.col("exp_band") + (F.col("haz_band") - 1) * n).cast("int").alias("band"), "row", "col", F.col("damage").alias("value")), grid, ["_".join(filter(None, (f"damage{i % n + 1}", b))) for i, (b, _) in enumerate(pairs)], [{"fn_damage": f} for _, f in pairs]),
        "total": rasters.Raster(out["total"].select(F.col("haz_band").alias("band"), "row", "col", F.col("total").alias("value")), grid, ["_".join(filter(None, ("total", b))) for b in bands], [{} for _ in bands]),
    }
    if "ead" in out:
        made["ead"] = rasters.Raster(out["ead"].select(F.lit(1).alias("band"), "row", "col", F.col("ead").alias("value")), grid, ["ead"], [{}])
    return made
