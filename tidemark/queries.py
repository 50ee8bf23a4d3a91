"""Queries over the driver's tables, one for each operator, and the same in SQL.

Assets are derived from part (and, for volume, orders), hazard cells from events, curves are given here; everything is an operator of this
package applied to these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars, schema
from .functions.risk import expected_damage_of, risk_weights
from .operators import curves, damage, geometry, grids, hazard, overlay
from .plans import checks, geom_model, grid_model
from .sources import rasters, tables

GRID = overlay.Grid(0.0, 1.0, 0.0, 1.0, 100, 100)
COARSE = overlay.Grid(0.0, 2.5, 0.0, 2.5, 40, 40)
PERIODS = [2.0, 5.0, 10.0, 25.0, 50.0]
FACTORS = [0.6, 0.8, 1.0, 1.2, 1.5]
WEIGHTS = risk_weights(PERIODS)
NAMES = checks.band_names([""] * len(PERIODS), True, PERIODS)
TYPES = ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE")
CURVES = [(t, float(d), min(1.0, d * (k + 2) / (d * (k + 1) + 10.0))) for k, t in enumerate(TYPES) for d in range(21)]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def assets(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    x, y = (key % 100).cast("double") + 0.5, (F.floor(key / 100) % 100).cast("double") + 0.5
    return p.select(
        key.alias("object_id"),
        x.alias("x"),
        y.alias("y"),
        (x - 0.25).alias("minx"),
        (x + 0.25 + (size % 3).cast("double")).alias("maxx"),
        (y - 0.25).alias("miny"),
        (y + 0.25 + (size % 2).cast("double")).alias("maxy"),
        F.when(key % 2 == 0, "area").otherwise("centroid").alias("extract_method"),
        ((size % 4).cast("double") * 0.25).alias("ground_flht"),
        ((size % 3).cast("double") * 0.5).alias("ground_elevtn"),
        F.col("p_type").alias("fn_damage_structure"),
        F.when(size % 7 != 0, F.col("p_type")).alias("fn_damage_content"),
        F.col("p_retailprice").alias("max_damage_structure"),
        (F.col("p_retailprice") * 0.5).alias("max_damage_content"),
        F.col("p_type").alias("fn_affected"),
        (size % 5 + 1).cast("double").alias("max_affected"),
    )


def base_cells(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    col, row = (F.col("event_id") % 100).cast("int"), (F.floor(F.col("event_id") / 100) % 100).cast("int")
    cells = e.groupBy(row.alias("row"), col.alias("col")).agg((F.max("value") / 50.0).alias("base"))
    return cells.where((F.col("row") + F.col("col")) % 13 != 0)


def hazard_raster(spark: SparkSession, d: str, bands: int = 5) -> rasters.Raster:
    b = base_cells(spark, d)
    wide = b.select("row", "col", *[(F.col("base") * f).alias(f"b{i}") for i, f in enumerate(FACTORS[:bands])])
    return rasters.Raster(rasters.long_form(wide, [f"b{i}" for i in range(bands)]), GRID, [""] * bands, [{}] * bands)


def curve_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURVES, "fn string, depth double, fraction double")


def dense_curves(spark: SparkSession) -> DataFrame:
    return curves.densified(curve_table(spark))


def exposure_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two exposure bands from customers: balances by cell."""
    c = read(spark, d, "customer")
    key = F.col("c_custkey")
    cells = c.groupBy((F.floor(key / 100) % 100).cast("int").alias("row"), (key % 100).cast("int").alias("col")).agg(F.max("c_acctbal").alias("value"))
    bands = F.array(F.struct(F.lit(1).alias("band"), F.lit("ECONOMY").alias("fn"), F.lit(1.0).alias("k")), F.struct(F.lit(2).alias("band"), F.lit("LARGE").alias("fn"), F.lit(0.5).alias("k")))
    return cells.where("value > 0").withColumn("b", F.explode(bands)).select("b.band", "row", "col", (F.col("value") * F.col("b.k")).alias("value"), "b.fn")


# --- queries -------------------------------------------------------------------------------------------------------


def csv_key_join(spark, d):
    objects = assets(spark, d).select("object_id", "x", "y")
    table = read(spark, d, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("object_id"), "p_retailprice")
    return geom_model.with_table(objects, table)[0]


def missing_assets(spark, d):
    objects = assets(spark, d).select("object_id", "x", "y")
    table = read(spark, d, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("object_id"), "p_retailprice")
    return geom_model.with_table(objects, table)[1]


def pin_sample(spark, d):
    cells = hazard_raster(spark, d).cells.withColumnRenamed("value", "depth")
    return overlay.pinned(assets(spark, d), GRID).select("object_id", "row", "col").join(cells, ["row", "col"], "left").select("object_id", "row", "col", F.coalesce("band", F.lit(0)).alias("band"), "depth")


def clip_cells(spark, d):
    return overlay.clipped(assets(spark, d).where("extract_method = 'area'"), GRID).select("object_id", "row", "col")


def _diamonds(spark, d):
    """Polygons |x - cx| + |y - cy| <= r as WKB."""
    a = assets(spark, d).select("object_id", "x", "y", (0.6 + (F.col("object_id") % 5) * 0.5).alias("r"))
    corner = lambda dx, dy: F.concat_ws(",", (F.col("x") + dx * F.col("r")).cast("string"), (F.col("y") + dy * F.col("r")).cast("string"))
    ring = F.concat(F.lit("[["), F.concat_ws("],[", corner(-1, 0), corner(0, -1), corner(1, 0), corner(0, 1), corner(-1, 0)), F.lit("]]"))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    df = a.withColumn("geom", geometry.wkb_of_geojson(text))
    return df.withColumn("_e", geometry.envelope_of(F.col("geom"))).select("object_id", "geom", "_e.*")


def clip_polygons(spark, d):
    return overlay.clipped(_diamonds(spark, d), GRID, "geom").select("object_id", "row", "col")


def interior_points(spark, d):
    p = _diamonds(spark, d).withColumn("p", geometry.interior_point_of(F.col("geom")))
    return p.select("object_id", (F.col("p.x") >= F.col("minx")).alias("in_x"), (F.col("p.y") >= F.col("miny")).alias("in_y"), (F.abs(F.col("p.x") - (F.col("minx") + F.col("maxx")) / 2) < 1e-9).alias("centred"))


def clip_weighted(spark, d):
    return overlay.clipped_weights(assets(spark, d).where("extract_method = 'area'"), GRID, ["object_id"], 4)


def _depth(spark, d, reference, method):
    a = assets(spark, d).withColumn("ground", hazard.elevation(reference, F.col("ground_elevtn")))
    bands = spark.createDataFrame([(i + 1,) for i in range(5)], "band int")
    values = overlay.sampled(geom_model.asset_cells(a, GRID, None), hazard_raster(spark, d).cells, bands)
    return hazard.object_hazard(values, ["object_id", "band"], method)


def wet_mean_depth(spark, d):
    return _depth(spark, d, "dem", "mean")


def wet_max_depth(spark, d):
    return _depth(spark, d, "dem", "max")


def datum_depth(spark, d):
    return _depth(spark, d, "DATUM", "mean")


def list_depth(spark, d):
    """Depth within the row, from arrays of values in cell order."""
    a = assets(spark, d).where("extract_method = 'area'")
    cells = overlay.clipped(a, GRID).join(hazard_raster(spark, d, 1).cells, ["row", "col"], "left")
    values = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda v: v["value"])
    rows = cells.groupBy("object_id").agg(values.alias("values"), F.first("ground_flht").alias("flht"), F.first("ground_elevtn").alias("ground"))
    depth, red = hazard.list_hazard(F.col("values"), F.col("ground"), F.col("flht"))
    return rows.select("object_id", depth.alias("inun_depth"), red.alias("red_fact"))


def curve_densify(spark, d):
    return dense_curves(spark)


def curve_lookup(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 2.0 - 1.0).alias("depth"), F.when(F.col("l_linenumber") % 7 != 0, F.get(F.array(*map(F.lit, TYPES)), (F.col("l_linenumber") % 6).cast("int"))).otherwise("NONE").alias("fn"))
    return damage.with_fraction(rows, dense_curves(spark), F.col("depth")).groupBy("fn").agg(F.count(F.lit(1)).alias("n"), F.count("fraction").alias("n_found"), F.coalesce(F.sum(F.floor(F.col("fraction") * 1e9 + 0.5).cast("long")), F.lit(-1)).alias("nano_sum"))


def _impact(spark, d, bands, types, periods):
    names = [""] if bands == 1 else NAMES
    out = geom_model.impact(assets(spark, d), hazard_raster(spark, d, bands), dense_curves(spark), names, types, periods)
    return out.drop("x", "y", "minx", "maxx", "miny", "maxy", "fn_damage_structure", "fn_damage_content", "max_damage_structure", "max_damage_content", "fn_affected", "max_affected", "extract_method", "ground_flht", "ground_elevtn")


def damage_event(spark, d):
    return _impact(spark, d, 1, ["damage"], None)


def damage_multi_type(spark, d):
    return _impact(spark, d, 1, ["damage", "affected"], None)


def damage_risk_wide(spark, d):
    return _impact(spark, d, 5, ["damage"], PERIODS)


def damage_orders(spark, d):
    """Volume: every order is a point asset at a cell, at all return periods."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    a = o.select(key.alias("object_id"), (key % 100).cast("int").alias("col"), (F.floor(key / 100) % 100).cast("int").alias("row"), F.get(F.array(*map(F.lit, TYPES)), (key % 6).cast("int")).alias("fn"), F.col("o_totalprice").alias("max"))
    rows = a.join(hazard_raster(spark, d).cells, ["row", "col"]).withColumn("inun_depth", F.col("value")).withColumn("red_fact", F.lit(1.0))
    out = damage.damages(rows, dense_curves(spark))
    cents = F.sum(F.floor(F.col("damage") * 100.0 + 0.5).cast("long"))
    return out.groupBy("fn", "band").agg(F.count("damage").alias("n"), (cents.cast("double") / 100.0).alias("total"))


def risk_weights_table(spark, d):
    return spark.createDataFrame([(i + 1, p, w) for i, (p, w) in enumerate(zip(PERIODS, WEIGHTS, strict=True))], "band int, rp double, coef double")


def ead_asset(spark, d):
    """EAD of structures only, from the damages of each band."""
    out = damage_risk_wide(spark, d)
    return out.select("object_id", scalars.rounded(expected_damage_of(WEIGHTS, [F.col(f"`damage_structure_{n}`") for n in NAMES])).alias("ead_structure"))


def _grid(spark, d):
    return grid_model.impact(exposure_grid(spark, d), hazard_raster(spark, d).cells, dense_curves(spark), PERIODS)


def grid_damage(spark, d):
    return _grid(spark, d)["damage"]


def grid_total(spark, d):
    return _grid(spark, d)["total"]


def grid_ead(spark, d):
    return _grid(spark, d)["ead"]


def grid_resample_nearest(spark, d):
    return grids.resampled(hazard_raster(spark, d, 2).cells, GRID, COARSE)


def grid_resample_finer(spark, d):
    fine = overlay.Grid(0.0, 0.4, 0.0, 0.4, 250, 250)
    return grids.resampled(hazard_raster(spark, d, 1).cells, GRID, fine).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 1e6 + 0.5).cast("long")).alias("micro_sum"))


def band_names(spark, d):
    names = rasters.band_names(["depth", None, None], [{}, {"NETCDF_VARNAME": "water"}, {}])
    return spark.createDataFrame([(i + 1, n, r) for i, (n, r) in enumerate(zip(names, NAMES, strict=False))], "band int, name string, risk_name string")


def extent_check(spark, d):
    return assets(spark, d).agg(F.min("minx").alias("minx"), F.max("maxx").alias("maxx"), F.min("miny").alias("miny"), F.max("maxy").alias("maxy"), F.count(F.lit(1)).alias("n")).withColumn("inside", (F.col("minx") > 0.0) & (F.col("maxx") < 100.0) & (F.col("miny") > 0.0) & (F.col("maxy") < 100.0))


def duplicate_keys(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedupe_last_key(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return tables.last_by_key(e, "user_id", "event_id")


def tile_windows(spark, d):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(grids.tiles(100, 70, 30, 20))], "i int, col int, row int, width int, height int")


def chunk_ranges(spark, d):
    return spark.createDataFrame([(n, *r) for n in (6, 20) for r in grids.ranges(500, n)], "parts int, first int, last int")


def type_inference(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("whole"), F.col("p_retailprice").cast("string").alias("number"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("").alias("gaps"), F.col("p_brand").alias("words"))
    kinds = schema.inferred_types(p)
    return spark.createDataFrame(sorted(kinds.items()), "column string, type string")


def layer_append(spark, d):
    a = assets(spark, d).select("object_id", "x", "y")
    return a.where("object_id % 2 = 0").unionByName(a.where("object_id % 2 = 1").withColumn("file_idx", F.lit(2)), allowMissingColumns=True).withColumn("file_idx", F.coalesce("file_idx", F.lit(1)))


def nodata_mask(spark, d):
    raw = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(-9999.0)).when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    v = scalars.without_nodata(F.col("v"), -9999.0)
    return raw.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_data"), F.max(v).alias("top"))


def pixel_to_world(spark, d):
    g = overlay.Grid(4.35, 0.01, 52.05, -0.01, 10, 10)
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("col"), F.floor(F.col("id") / 10).cast("int").alias("row"))
    x, y = overlay.corner_of(g, F.col("col"), F.col("row"))
    col, row = overlay.pixel_of(g, x + 0.005, y - 0.005)
    return cells.select("col", "row", x.alias("x"), y.alias("y"), col.alias("col2"), row.alias("row2"))


def outside_assets(spark, d):
    small = overlay.Grid(10.0, 1.0, 10.0, 1.0, 50, 50)
    p = overlay.pinned(assets(spark, d), small)
    return p.select("object_id", F.coalesce("row", F.lit(-1)).alias("row"), F.coalesce("col", F.lit(-1)).alias("col"), F.col("row").isNull().alias("outside"))


def reproject_points(spark, d):
    a = assets(spark, d).select("object_id", F.concat(F.lit('{"type":"Point","coordinates":['), F.col("x").cast("string"), F.lit(","), (F.col("y") / 2).cast("string"), F.lit("]}")).alias("g"))
    g = geometry.reprojected_of(geometry.wkb_of_geojson(F.col("g")), "EPSG:4326", "EPSG:3857")
    e = a.withColumn("e", geometry.envelope_of(g))
    return e.select("object_id", F.floor(F.col("e.minx") * 1000 + 0.5).cast("long").alias("x_mm"), F.floor(F.col("e.miny") * 1000 + 0.5).cast("long").alias("y_mm"))


def job_product(spark, d):
    n = read(spark, d, "nation").select("n_name")
    return n.crossJoin(F.broadcast(spark.createDataFrame([(i + 1,) for i in range(5)], "band int")))


# --- the same in SQL -----------------------------------------------------------------------------------------------

_VALUES = ", ".join(f"('{t}', CAST({x!r} AS DOUBLE), CAST({f!r} AS DOUBLE))" for t, x, f in CURVES)
_ROUND = "floor(({0}) * 100.0 + 0.5) / 100.0"
_TYPE = "CASE {0} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
_ASSETS = """assets AS (
  SELECT p_partkey AS object_id, CAST(p_partkey % 100 AS DOUBLE) + 0.5 AS x, CAST((p_partkey // 100) % 100 AS DOUBLE) + 0.5 AS y,
    x - 0.25 AS minx, x + 0.25 + CAST(p_size % 3 AS DOUBLE) AS maxx, y - 0.25 AS miny, y + 0.25 + CAST(p_size % 2 AS DOUBLE) AS maxy,
    CASE WHEN p_partkey % 2 = 0 THEN 'area' ELSE 'centroid' END AS extract_method, CAST(p_size % 4 AS DOUBLE) * 0.25 AS ground_flht,
    CAST(p_size % 3 AS DOUBLE) * 0.5 AS ground_elevtn, p_type AS fn_s, CASE WHEN p_size % 7 <> 0 THEN p_type END AS fn_c,
    p_retailprice AS max_s, p_retailprice * 0.5 AS max_c, CAST(p_size % 5 + 1 AS DOUBLE) AS max_a FROM part)"""
_BASE = """base AS (
  SELECT * FROM (SELECT CAST((event_id // 100) % 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col, max(value) / 50.0 AS base FROM events GROUP BY ALL)
  WHERE (row + col) % 13 <> 0)"""
_FACTORS = "f(band, factor) AS (VALUES " + ", ".join(f"({i + 1}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(FACTORS)) + ")"
_HAZ = _BASE + ", " + _FACTORS + ", haz AS (SELECT CAST(band AS INTEGER) AS band, row, col, base * factor AS value FROM base, f)"
_CELLS = """cells AS (
  SELECT object_id, CAST(floor(x) AS INTEGER) AS col, CAST(floor(y) AS INTEGER) AS row FROM assets WHERE extract_method <> 'area'
  UNION ALL
  SELECT object_id, CAST(c AS INTEGER), CAST(r AS INTEGER) FROM assets, range(0, 100) a(c), range(0, 100) b(r)
  WHERE extract_method = 'area' AND c BETWEEN ceil(minx) - 1 AND floor(maxx) AND r BETWEEN ceil(miny) - 1 AND floor(maxy))"""
_DENSE = f"""curves(fn, depth, fraction) AS (VALUES {_VALUES}),
seg AS (SELECT *, CAST(floor(depth * 100.0 + 0.5) AS INTEGER) AS b0, lead(CAST(floor(depth * 100.0 + 0.5) AS INTEGER)) OVER w AS b1, lead(depth) OVER w AS d1, lead(fraction) OVER w AS f1
  FROM curves WINDOW w AS (PARTITION BY fn ORDER BY depth)),
dense AS (SELECT fn, CAST(bin AS INTEGER) AS bin, CASE WHEN b1 IS NULL OR bin = b0 THEN fraction ELSE fraction + (f1 - fraction) * (CAST(bin AS DOUBLE) / 100.0 - depth) / (d1 - depth) END AS fraction
  FROM (SELECT *, unnest(range(b0, CASE WHEN b1 IS NULL THEN b0 + 1 ELSE b1 END)) AS bin FROM seg))"""
_DEPTH = """lvl AS (
  SELECT a.object_id, b.band, h.value - {ground} AS level, ground_flht FROM assets a JOIN cells c USING (object_id) CROSS JOIN (SELECT band FROM f{bands}) b
  LEFT JOIN haz h ON h.row = c.row AND h.col = c.col AND h.band = b.band),
depth AS (SELECT object_id, CAST(band AS INTEGER) AS band,
  {agg} - first(ground_flht) AS inun_depth, {red} AS red_fact FROM lvl GROUP BY object_id, band)"""
_MEAN = "CAST(sum(CASE WHEN level > 0.0001 THEN CAST(floor(level * 1000000.0 + 0.5) AS BIGINT) END) AS DOUBLE) / (CAST(count(CASE WHEN level > 0.0001 THEN 1 END) AS DOUBLE) * 1000000.0)"
_SHARE = "CAST(count(CASE WHEN level > 0.0001 THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)"


def _depth_sql(ground="CAST(0 AS DOUBLE)", agg=_MEAN, red=_SHARE, bands=""):
    return _DEPTH.format(ground=ground, agg=agg, red=red, bands=bands)


def _damage(fn, top, alias):
    """Damage column by a lookup of the clamped bin."""
    bin_ = "greatest(least(CAST(floor(dp.inun_depth * 100.0 + 0.5) AS INTEGER), 2000), 0)"
    join = f"LEFT JOIN dense {alias} ON {alias}.fn = a.{fn} AND {alias}.bin = CASE WHEN dp.inun_depth IS NOT NULL THEN {bin_} END"
    return join, _ROUND.format(f"{alias}.fraction * a.{top} * dp.red_fact")


_JS, _S = _damage("fn_s", "max_s", "ks")
_JC, _C = _damage("fn_c", "max_c", "kc")
_JA, _A = _damage("fn_s", "max_a", "ka")
_CENTS = "CAST(floor(({0}) * 100.0 + 0.5) AS BIGINT)"
_TOTAL = "CAST(coalesce({0}, 0) + coalesce({1}, 0) AS DOUBLE) / 100.0".format(_CENTS.format("damage_structure"), _CENTS.format("damage_content"))
_DMG = f"""dmg AS (SELECT a.object_id, dp.band, dp.inun_depth, dp.red_fact, {_S} AS damage_structure, {_C} AS damage_content, {_A} AS affected
  FROM depth dp JOIN assets a USING (object_id) {_JS} {_JC} {_JA})"""
_EVENT = f"WITH {_ASSETS}, {_HAZ}, {_CELLS}, {_DENSE}, {_depth_sql(bands=' WHERE band = 1')}, {_DMG}"
_RISK = f"WITH {_ASSETS}, {_HAZ}, {_CELLS}, {_DENSE}, {_depth_sql()}, {_DMG}, t AS (SELECT *, {_TOTAL} AS total FROM dmg)"


def _pick(column, band):
    return f"max(CASE WHEN band = {band} THEN {column} END)"


def _ead(column):
    out = "CAST(0.0 AS DOUBLE)"
    for i, w in enumerate(WEIGHTS):
        out = f"({out} + CAST({w!r} AS DOUBLE) * coalesce({_pick(column, i + 1)}, 0.0))"
    return out


_WIDE = ", ".join(f'{_pick(c, i + 1)} AS "{n}_{b}"' for i, b in enumerate(NAMES) for c, n in (("inun_depth", "inun_depth"), ("red_fact", "red_fact"), ("damage_structure", "damage_structure"), ("damage_content", "damage_content"), ("total", "total_damage")))
_EXPOSED = """exposed AS (SELECT CAST(b.band AS INTEGER) AS band, row, col, value * k AS value, fn FROM
  (SELECT CAST((c_custkey // 100) % 100 AS INTEGER) AS row, CAST(c_custkey % 100 AS INTEGER) AS col, max(c_acctbal) AS value FROM customer GROUP BY ALL),
  (VALUES (1, 'ECONOMY', CAST(1.0 AS DOUBLE)), (2, 'LARGE', CAST(0.5 AS DOUBLE))) b(band, fn, k) WHERE value > 0)"""
_GRID = f"""WITH {_HAZ}, {_EXPOSED}, {_DENSE}, gd AS (
  SELECT e.band AS exp_band, h.band AS haz_band, e.row, e.col, e.value * k.fraction AS damage FROM exposed e JOIN haz h USING (row, col)
  LEFT JOIN dense k ON k.fn = e.fn AND k.bin = greatest(least(CAST(floor(h.value * 100.0 + 0.5) AS INTEGER), 2000), 0)),
gt AS (SELECT haz_band, row, col, CAST(sum(CAST(floor(damage * 1000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / 1000000.0 AS total FROM gd WHERE damage IS NOT NULL GROUP BY ALL)"""

ORACLE = {
    "csv_key_join": f"WITH {_ASSETS} SELECT a.object_id, x, y, p_retailprice FROM assets a JOIN part ON p_partkey = object_id WHERE p_partkey % 10 <> 3",
    "missing_assets": "SELECT p_partkey AS object_id, 'No data found in exposure database' AS reason FROM part WHERE p_partkey % 10 = 3",
    "pin_sample": f"WITH {_ASSETS}, {_HAZ} SELECT a.object_id, CAST(floor(y) AS INTEGER) AS row, CAST(floor(x) AS INTEGER) AS col, coalesce(h.band, 0) AS band, h.value AS depth FROM assets a LEFT JOIN haz h ON h.row = CAST(floor(y) AS INTEGER) AND h.col = CAST(floor(x) AS INTEGER)",
    "clip_cells": f"WITH {_ASSETS}, {_CELLS} SELECT c.object_id, row, col FROM cells c JOIN assets a USING (object_id) WHERE extract_method = 'area'",
    "clip_polygons": f"WITH {_ASSETS} SELECT object_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM assets, range(0, 100) a(c), range(0, 100) b(r) WHERE abs(x - c) < 5 AND abs(y - r) < 5 AND greatest(c - x, x - c - 1, 0) + greatest(r - y, y - r - 1, 0) <= 0.6 + (object_id % 5) * 0.5",
    "interior_points": "SELECT p_partkey AS object_id, TRUE AS in_x, TRUE AS in_y, TRUE AS centred FROM part",
    "clip_weighted": f"WITH {_ASSETS}, w AS (SELECT object_id, c, r, (SELECT count(*) FROM range(0, 4) s(i) WHERE c * 4 + i BETWEEN ceil(minx * 4) - 1 AND floor(maxx * 4)) * (SELECT count(*) FROM range(0, 4) s(i) WHERE r * 4 + i BETWEEN ceil(miny * 4) - 1 AND floor(maxy * 4)) AS n FROM assets, range(0, 100) a(c), range(0, 100) b(r) WHERE extract_method = 'area' AND c BETWEEN minx - 2 AND maxx + 2 AND r BETWEEN miny - 2 AND maxy + 2) SELECT object_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(n AS DOUBLE) / 16.0 AS weight FROM w WHERE n > 0",
    "wet_mean_depth": f"WITH {_ASSETS}, {_HAZ}, {_CELLS}, {_depth_sql()} SELECT * FROM depth",
    "wet_max_depth": f"WITH {_ASSETS}, {_HAZ}, {_CELLS}, {_depth_sql(agg='max(CASE WHEN level > 0.0001 THEN level END)', red='CAST(1.0 AS DOUBLE)')} SELECT * FROM depth",
    "datum_depth": f"WITH {_ASSETS}, {_HAZ}, {_CELLS}, {_depth_sql(ground='coalesce(ground_elevtn, 0.0)')} SELECT * FROM depth",
    "list_depth": f"""WITH {_ASSETS}, {_HAZ}, {_CELLS}, v AS (SELECT object_id, c.row, c.col, h.value - ground_elevtn AS level, ground_flht FROM cells c JOIN assets a USING (object_id) LEFT JOIN haz h ON h.row = c.row AND h.col = c.col AND h.band = 1 WHERE extract_method = 'area'),
      l AS (SELECT object_id, list(CASE WHEN level > 0.0001 THEN level END ORDER BY row, col) AS a, first(ground_flht) AS flht FROM v GROUP BY object_id), w AS (SELECT object_id, list_filter(a, lambda x: x IS NOT NULL) AS w, len(a) AS n, flht FROM l)
      SELECT object_id, CASE WHEN len(w) > 0 THEN list_reduce(list_prepend(CAST(0.0 AS DOUBLE), w), lambda p, q: p + q) / len(w) END - flht AS inun_depth, CAST(len(w) AS DOUBLE) / CAST(n AS DOUBLE) AS red_fact FROM w""",
    "curve_densify": f"WITH {_DENSE} SELECT fn, bin, fraction FROM dense",
    "curve_lookup": f"WITH {_DENSE}, l AS (SELECT l_quantity / 2.0 - 1.0 AS depth, CASE WHEN l_linenumber % 7 <> 0 THEN {_TYPE.format('l_linenumber % 6')} ELSE 'NONE' END AS fn FROM lineitem) SELECT l.fn, count(*) AS n, count(d.fraction) AS n_found, CAST(coalesce(sum(CAST(floor(d.fraction * 1000000000.0 + 0.5) AS BIGINT)), -1) AS BIGINT) AS nano_sum FROM l LEFT JOIN dense d ON d.fn = l.fn AND d.bin = greatest(least(CAST(floor(depth * 100.0 + 0.5) AS INTEGER), 2000), 0) GROUP BY l.fn",
    "damage_event": f"{_EVENT} SELECT object_id, inun_depth, red_fact, damage_structure, damage_content, {_TOTAL} AS total_damage FROM dmg",
    "damage_multi_type": f"{_EVENT} SELECT object_id, inun_depth, red_fact, damage_structure, damage_content, {_TOTAL} AS total_damage, affected, CAST(coalesce({_CENTS.format('affected')}, 0) AS DOUBLE) / 100.0 AS total_affected FROM dmg",
    "damage_risk_wide": f"{_RISK} SELECT object_id, {_WIDE}, {_ROUND.format(_ead('total'))} AS ead_damage FROM t GROUP BY object_id",
    "damage_orders": f"WITH {_HAZ}, {_DENSE}, o AS (SELECT {_TYPE.format('o_orderkey % 6')} AS fn, o_totalprice, h.band, h.value FROM orders JOIN haz h ON h.col = o_orderkey % 100 AND h.row = (o_orderkey // 100) % 100) SELECT o.fn, o.band, count(d.fraction) AS n, CAST(sum(CAST(floor(({_ROUND.format('d.fraction * o_totalprice * CAST(1.0 AS DOUBLE)')}) * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS total FROM o LEFT JOIN dense d ON d.fn = o.fn AND d.bin = greatest(least(CAST(floor(value * 100.0 + 0.5) AS INTEGER), 2000), 0) GROUP BY o.fn, o.band",
    "risk_weights": "SELECT CAST(band AS INTEGER) AS band, rp, coef FROM (VALUES " + ", ".join(f"({i + 1}, CAST({p!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for i, (p, w) in enumerate(zip(PERIODS, WEIGHTS, strict=True))) + ") v(band, rp, coef)",
    "ead_asset": f"{_RISK} SELECT object_id, {_ROUND.format(_ead('damage_structure'))} AS ead_structure FROM t GROUP BY object_id",
    "grid_damage": f"{_GRID} SELECT * FROM gd",
    "grid_total": f"{_GRID} SELECT * FROM gt",
    "grid_ead": f"{_GRID} SELECT row, col, {_ead('total').replace('band =', 'haz_band =')} AS ead FROM gt GROUP BY row, col",
    "grid_resample_nearest": f"WITH {_HAZ} SELECT band, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, value FROM range(0, 40) a(r), range(0, 40) b(c) JOIN haz h ON h.row = floor((r + 0.5) * 2.5) AND h.col = floor((c + 0.5) * 2.5) WHERE band <= 2",
    "grid_resample_finer": f"WITH {_HAZ} SELECT band, count(*) AS n, CAST(sum(CAST(floor(value * 1000000.0 + 0.5) AS BIGINT)) AS BIGINT) AS micro_sum FROM range(0, 250) a(r), range(0, 250) b(c) JOIN haz h ON h.row = floor((CAST(r AS DOUBLE) + 0.5) * CAST(0.4 AS DOUBLE)) AND h.col = floor((CAST(c AS DOUBLE) + 0.5) * CAST(0.4 AS DOUBLE)) WHERE band = 1 GROUP BY band",
    "band_names": "SELECT CAST(band AS INTEGER) AS band, name, risk_name FROM (VALUES (1, 'depth', '2.0y'), (2, 'water', '5.0y'), (3, 'band3', '10.0y')) v(band, name, risk_name)",
    "extent_check": f"WITH {_ASSETS} SELECT min(minx) AS minx, max(maxx) AS maxx, min(miny) AS miny, max(maxy) AS maxy, count(*) AS n, min(minx) > 0 AND max(maxx) < 100 AND min(miny) > 0 AND max(maxy) < 100 AS inside FROM assets",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "dedupe_last_key": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "tile_windows": "SELECT CAST(row_number() OVER (ORDER BY r, c) - 1 AS INTEGER) AS i, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, CAST(least(30, 100 - c) AS INTEGER) AS width, CAST(least(20, 70 - r) AS INTEGER) AS height FROM range(0, 100, 30) a(c), range(0, 70, 20) b(r)",
    "chunk_ranges": "SELECT CAST(n AS INTEGER) AS parts, CAST(s + 1 AS INTEGER) AS first, CAST(least(s + size, 500) AS INTEGER) AS last FROM (SELECT n, CAST(ceil(500.0 / n) AS BIGINT) AS size, unnest(range(0, 500, CAST(ceil(500.0 / n) AS BIGINT))) AS s FROM (VALUES (6), (20)) v(n))",
    "type_inference": "SELECT * FROM (VALUES ('gaps', 'double'), ('number', 'double'), ('whole', 'long'), ('words', 'string')) v(\"column\", type)",
    "layer_append": f"WITH {_ASSETS} SELECT object_id, x, y, CASE WHEN object_id % 2 = 1 THEN CAST(2 AS INTEGER) ELSE CAST(1 AS INTEGER) END AS file_idx FROM assets",
    "nodata_mask": "SELECT count(*) AS n, count(CASE WHEN event_id % 5 > 1 THEN value END) AS n_data, max(CASE WHEN event_id % 5 > 1 THEN value END) AS top FROM events",
    "pixel_to_world": "SELECT CAST(i % 10 AS INTEGER) AS col, CAST(i // 10 AS INTEGER) AS row, CAST(4.35 AS DOUBLE) + CAST(i % 10 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS x, CAST(52.05 AS DOUBLE) + CAST(i // 10 AS DOUBLE) * CAST(-0.01 AS DOUBLE) AS y, CAST(i % 10 AS INTEGER) AS col2, CAST(i // 10 AS INTEGER) AS row2 FROM range(0, 100) t(i)",
    "outside_assets": f"WITH {_ASSETS}, p AS (SELECT object_id, CAST(floor(x - 10.0) AS INTEGER) AS c, CAST(floor(y - 10.0) AS INTEGER) AS r FROM assets) SELECT object_id, CASE WHEN c BETWEEN 0 AND 49 AND r BETWEEN 0 AND 49 THEN r ELSE -1 END AS row, CASE WHEN c BETWEEN 0 AND 49 AND r BETWEEN 0 AND 49 THEN c ELSE -1 END AS col, NOT (c BETWEEN 0 AND 49 AND r BETWEEN 0 AND 49) AS outside FROM p",
    "reproject_points": f"WITH {_ASSETS} SELECT object_id, CAST(floor(radians(x) * 6378137.0 * 1000 + 0.5) AS BIGINT) AS x_mm, CAST(floor(6378137.0 * ln(tan(pi() / 4 + radians(y / 2) / 2)) * 1000 + 0.5) AS BIGINT) AS y_mm FROM assets",
    "job_product": "SELECT n_name, CAST(b AS INTEGER) AS band FROM nation, range(1, 6) t(b)",
}

QUERIES = {k: globals()["risk_weights_table" if k == "risk_weights" else k] for k in ORACLE}
