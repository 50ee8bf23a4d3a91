"""Vector model: objects on hazard grids to damages, totals and expected annual damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.risk import expected_damage_of, risk_weights
from ..functions.scalars import rounded
from ..functions.schema import exposure_columns, output_columns
from ..operators import curves, damage, geometry, overlay
from ..sources import rasters, tables, vectors
from . import checks
from .config import Config, table_decimals
from .plugins import hazard_type

MANDATORY = ("hazard.file", "vulnerability.file", r"exposure.geom.file\d+")


#: Name a feature within the model, as object ids may be repeated or null: two hashes of all its columns. Equal features have equal results.
KEYS = ["_k1", "_k2"]


def with_keys(assets: DataFrame) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in assets.columns]
    return assets.withColumns({"_k1": F.xxhash64(*columns), "_k2": F.xxhash64(F.lit("feature"), *columns)})


def asset_cells(assets: DataFrame, grid: overlay.Grid, geom: str | None, keys: list[str] = ("object_id",)) -> DataFrame:
    """keys, ground, ground_flht, row, col: a row for each touched cell (method `area`) or the point's cell, NULL outside."""
    keep = [*keys, "ground", "ground_flht", "row", "col"]
    area = F.lower("extract_method") == "area"
    points = assets.where(~F.coalesce(area, F.lit(False)))
    if geom is not None:
        points = points.withColumn("_p", geometry.interior_point_of(F.col(geom))).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y"))
    points = overlay.pinned(points, grid).select(*keep)
    # areas without any cell keep a row
    touched = overlay.clipped(assets.where(area), grid, geom, outer=True).select(*keep)
    return points.unionByName(touched)


def impact(assets: DataFrame, hazard: rasters.Raster, dense: DataFrame, bands: list[str], types: list[str] = ("damage",), periods: list[float] | None = None, settings: dict | None = None, geom: str | None = None, method: str = "mean") -> DataFrame:
    """Assets with, for each band, depth, reduction factor, damages and totals, and expected annual damage if there are return periods. Each feature counts for itself, whatever its object_id."""
    settings = settings or {}
    kind = hazard_type(str(settings.get("hazard.type", "flood")))
    decimals = table_decimals(settings)
    spark = assets.sparkSession
    found = {}
    for t in types:
        suffixes, columns, missing = exposure_columns(assets.columns, t)
        checks.derived_types(t, suffixes, missing)
        found[t] = (suffixes, columns)
    band_rows = spark.createDataFrame([(i + 1,) for i in range(len(bands))], "band int")
    keyed = with_keys(assets)
    levelled = keyed.withColumn("ground", kind.level(settings, F.col("ground_elevtn")))
    values = overlay.sampled(asset_cells(levelled, hazard.grid, geom, KEYS), hazard.cells, band_rows)
    depth = kind.of_objects(values, [*KEYS, "band"], method)
    components = {t + s: {"fn": c["fn"][s], "max": c["max"][s]} for t, (suffixes, c) in found.items() for s in suffixes}
    rows = damage.component_rows(keyed, components, KEYS).join(depth, KEYS)
    rows = damage.damages(rows, dense, decimals)
    at = lambda b, c, v: F.max(F.when((F.col("band") == b) & (F.col("component") == c), F.col(v)))
    # the largest of a component's equal values, so that a feature that occurs twice isn't summed
    one = lambda b, c: F.coalesce(F.floor(at(b, c, "damage") * 100.0 + 0.5).cast("long"), F.lit(0))
    cents = lambda b, t: sum((one(b, t + s) for s in found[t][0]), F.lit(0).cast("long")).cast("double") / 100.0
    first = next(iter(components))
    wide = []
    for i, name in enumerate(bands):
        end = f"_{name}" if name else ""
        wide += [at(i + 1, first, "inun_depth").alias(f"inun_depth{end}"), at(i + 1, first, "red_fact").alias(f"red_fact{end}")]
        for t, (suffixes, _) in found.items():
            wide += [at(i + 1, t + s, "damage").alias(f"{t}{s}{end}") for s in suffixes] + [cents(i + 1, t).alias(f"total_{t}{end}")]
    out = rows.groupBy(*KEYS).agg(*wide)
    extra = []
    if periods:
        weights, extra = risk_weights(periods), ["ead"]
        out = out.withColumns({f"ead_{t}": rounded(expected_damage_of(weights, [F.col(f"`total_{t}_{name}`") for name in bands]), decimals) for t in types})
    names = output_columns(list(kind.new_columns), {t: found[t][0] for t in types}, bands, extra)
    return keyed.join(out, KEYS, "left").select(*assets.columns, *[F.col(f"`{n}`") for n in names])


def with_table(objects: DataFrame, table: DataFrame, index: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """(objects with their row of the exposure table, rejects: objects without one)."""
    extra = [c for c in table.columns if c == index or c not in objects.columns]
    rejects = objects.join(table.select(index), index, "left_anti").select(F.col(index).alias("object_id"), F.lit("No data found in exposure database").alias("reason"))
    return objects.join(table.select(*extra), index), rejects


def model_srs(config: Config, hazard_srs: str) -> str:
    """The hazard grid's system, unless the settings prefer their own."""
    return str(config.get("model.srs.value", "EPSG:4326")) if config.get("model.srs.prefer_global", False) else hazard_srs


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """The model of a settings file: a table for each exposure file, written to the output folder."""
    kind = hazard_type(str(config.get("hazard.type", "flood")))
    checks.entries(config.keys(), [*MANDATORY, *kind.entries])
    checks.existing_entries(config, [*MANDATORY, "exposure.csv.file"])
    hazard = rasters.read_raster(spark, config.path("hazard.file"), config.get("hazard.srs"))
    srs = model_srs(config, hazard.grid.srs)
    checks.global_srs(srs)
    if not checks.same_srs(srs, hazard.grid.srs):
        raise DataError(f"the hazard grid is in {hazard.grid.srs}, the model in {srs}; grids aren't reprojected")
    risk = bool(config.get("model.risk", False))
    periods = checks.return_periods([m.get("return_period") for m in hazard.meta], config.get("hazard.return_periods"), config["hazard.file"]) if risk else None
    bands = checks.band_names(hazard.names, risk, periods)
    table = tables.read_csv(spark, config.path("vulnerability.file"), str(config.get("vulnerability.csv.sep", ",")))
    depth = str(config.get("vulnerability.csv.index", "water depth"))
    decimals = table_decimals(config)
    dense = curves.densified(curves.unpivoted(table.df, depth), decimals).cache()
    exposure = tables.read_csv(spark, config.path("exposure.csv.file"), str(config.get("exposure.csv.sep", ","))).df if "exposure.csv.file" in config else None
    index = str(config.get("exposure.csv.index", "object_id"))
    results = {}
    for i, key in enumerate(config.numbered("exposure.geom.file"), 1):
        objects, srs = vectors.read_vector(spark, config.path(key), srs=config.get("exposure.geom.srs"))
        checks.has_srs(srs, config[key])
        checks.unique_columns([c.lower() for c in objects.columns])
        checks.index_column(objects.columns, "object_id")
        if not checks.same_srs(srs, hazard.grid.srs):
            objects = objects.withColumn("geom", geometry.reprojected_of(F.col("geom"), srs, hazard.grid.srs)).drop("minx", "maxx", "miny", "maxy")
            objects = vectors.with_envelope(objects)
        if exposure is not None:
            checks.index_column(exposure.columns, index)
            renamed = exposure.withColumnRenamed(index, "object_id")
            keyed = tables.last_by_key(renamed.withColumn("_o", F.monotonically_increasing_id()), "object_id", "_o").drop("_o")
            objects, rejects = with_table(objects, keyed)
            tables.write_rejects(rejects, f"{config.output}/missing_{i}")
        checks.exposure_columns("object_id", objects.columns, list(kind.columns))
        if (extent := vectors.bounds(objects)) is not None:
            checks.extent_within(extent, hazard.grid)
        out = impact(objects, hazard, dense, bands, list(config.get("exposure.types", ["damage"])), periods, config, "geom")
        name = str(config.get(f"output.geom.name{i}", f"spatial{i}"))
        vectors.write_vector(out, f"{config.output}/{name}" if "." in name else f"{config.output}/{name}.parquet", srs=hazard.grid.srs)
        if f"output.csv.name{i}" in config:
            tables.write_csv(out.drop("geom", "minx", "maxx", "miny", "maxy"), f"{config.output}/{config[f'output.csv.name{i}']}")
        results[name] = out
    return results
