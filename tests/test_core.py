import json
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import DataError, DriverError
from tidemark.functions import risk, scalars, schema
from tidemark.operators import curves, geometry, grids, hazard, overlay
from tidemark.plans import checks, geom_model, plugins
from tidemark.plans.config import Config, parsed_value
from tidemark.sources import rasters, tables, vectors


def test_risk_weights():
    w = risk.risk_weights([1, 2, 5, 25, 50, 100])
    assert sum(w) == pytest.approx(1.0)
    assert risk.expected_damage(w, [5, 10, 50, 300, 1200, 3000]) == pytest.approx(98.49343647)
    assert risk.risk_weights([2, 5, 10, 25]) == pytest.approx([0.17259299961881247, 0.1831374962922911, 0.07878810401265884, 0.06548140007623751])
    assert risk.expected_damage(risk.risk_weights([10]), [5]) == 0.5
    assert risk.risk_weights([25, 2, 10, 5]) == pytest.approx([0.06548140007623751, 0.17259299961881247, 0.07878810401265884, 0.1831374962922911])


@pytest.mark.parametrize(
    ("values", "reference", "ground", "depth", "red"),
    [([2.5, 5, 10], "dem", 0, 4.8333, 1), ([0, 2.5, 5, 10], "dem", 0, 4.8333, 0.75), ([0, 2.5, 5, 10], "datum", 1, 3.8333, 0.75), ([0, 1.5, 5, 10], "datum", 1, 3.50, 0.75), ([], "dem", 0, None, None), ([float("nan")], "dem", 0, None, 0)],
)
def test_depth(spark, values, reference, ground, depth, red):
    df = spark.createDataFrame([(list(map(float, values)), float(ground))], "v array<double>, g double")
    d, r = hazard.list_hazard(F.col("v"), hazard.elevation(reference, F.col("g")), F.lit(1.0))
    got = df.select(d.alias("d"), r.alias("r")).first()
    assert got["r"] == red and (got["d"] is None if depth is None else got["d"] == pytest.approx(depth, abs=1e-4))


def test_depth_max(spark):
    df = spark.createDataFrame([([2.5, 5.0, 10.0],)], "v array<double>")
    d, r = hazard.list_hazard(F.col("v"), F.lit(0.0), F.lit(1.0), "max")
    assert tuple(df.select(d, r).first()) == (9.0, 1.0)


def test_rounding(spark):
    xs = [2.675, 0.125, 1.005, 0.285, 1.115]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(scalars.exactly_rounded(F.col("x"))).collect()] == [round(x, 2) for x in xs]
    assert scalars.step_decimals(1e-5) == 5 and scalars.step_decimals(0.01) == 2


def test_clamped(spark):
    df = spark.createDataFrame([(-1.0,), (5.0,), (30.0,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.clamped(F.col("x"), 0.0, 20.0)).collect()] == [0.0, 5.0, 20.0, None]


def test_columns():
    names = ["object_id", "fn_damage_structure", "max_damage_structure", "fn_damage_content", "fn_damage", "max_damage", "fn_damage_"]
    found, by, missing = schema.exposure_columns(names, "damage")
    assert found == ["_structure", ""] and missing == ["_content"] and by["max"][""] == "max_damage"
    assert schema.output_columns(["inun_depth", "red_fact"], {"damage": ["_structure"]}) == ["inun_depth", "red_fact", "damage_structure", "total_damage"]
    wide = schema.output_columns(["inun_depth", "red_fact"], {"damage": ["_structure"]}, ["1", "2"], ["ead"])
    assert len(wide) == 9 and wide[4] == "inun_depth_2" and wide[-1] == "ead_damage"
    assert schema.repaired_header(["a", "", "a"]) == ["a_0", "Unnamed_1", "a_1"] and schema.repaired_header(None, 2) == ["col_0", "col_1"]
    assert schema.duplicates([1, 2, 3, 4, 1, 5, 5]) == [1, 5] and schema.matching(["ab", "cd"], "a") == ["ab"]


def test_types(spark):
    df = spark.createDataFrame([("2", "2.2", "2", "x", "1E5"), ("2", "2", "", "2", "1"), ("-3", "2", "2", "2", "1")], "i string, f string, g string, s string, e string")
    assert schema.inferred_types(df) == {"i": "long", "f": "double", "g": "double", "s": "string", "e": "double"}
    assert schema.typed(df).collect()[1]["g"] is None


def test_grids_and_ranges():
    assert grids.ranges(500, 6)[0] == (1, 84) and grids.ranges(500, 6)[-1] == (421, 500) and grids.ranges(500, 20)[-1] == (476, 500)
    assert len(grids.tiles(10, 10, 2, 2)) == 25 and grids.tiles(10, 10, 4, 4)[-1] == (8, 8, 2, 2)


def test_densify_is_interpolation(spark):
    xs, ys = [0.0, 0.5, 2.0, 3.25], [0.0, 0.4, 0.5, 1.0]
    rows = curves.densified(spark.createDataFrame([("a", x, y) for x, y in zip(xs, ys, strict=True)], "fn string, depth double, fraction double")).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == list(range(326))
    assert [r["fraction"] for r in rows] == pytest.approx(np.interp([b / 100 for b in range(326)], xs, ys).tolist(), abs=1e-12)


def _polygon(rng):
    n = rng.randint(3, 9)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return np.array([(5 + rng.uniform(0.5, 4) * math.cos(a), 5 + rng.uniform(0.5, 4) * math.sin(a)) for a in angles])


def test_geometry_against_sampling():
    rng = random.Random(3)
    for _ in range(60):
        shape = ("polygon", [_polygon(rng)])
        assert geometry.touches_box(geometry.from_wkb(geometry.to_wkb(*shape)), geometry.envelope(shape))
        x, y = geometry.interior_point(shape)
        assert geometry.contains(shape, x, y)
        for _ in range(30):
            a, b = rng.uniform(0, 9), rng.uniform(0, 9)
            box = (a, a + 1, b, b + 1)
            hit = any(geometry.contains(shape, a + i / 12, b + j / 12) for i in range(13) for j in range(13))
            assert geometry.touches_box(shape, box) or not hit
            if not hit and not any(a <= p[0] <= a + 1 and b <= p[1] <= b + 1 for p in shape[1][0]):
                edges = np.concatenate([shape[1][0] + (np.roll(shape[1][0], -1, 0) - shape[1][0]) * t for t in np.linspace(0, 1, 400)[:, None, None]])
                near = ((edges[:, 0] >= a) & (edges[:, 0] <= a + 1) & (edges[:, 1] >= b) & (edges[:, 1] <= b + 1)).any()
                assert near <= geometry.touches_box(shape, box)


def test_touched_runs_against_each_cell():
    """Half of the shapes lie on cell borders and corners; several shapes at a time, rows and columns in both directions."""
    rng = np.random.default_rng(5)
    for transform in ((0.0, 1.0, 0.0, 1.0), (0.0, 1.0, 10.0, -1.0), (10.0, -1.25, 0.1, 0.7)):
        shapes, windows = [], []
        for t in range(150):
            kind = ("polygon", "line", "point")[t % 3]
            parts = [rng.uniform(-3, 13, (rng.integers(3, 9) if kind == "polygon" else rng.integers(1, 6) if kind == "line" else 1, 2)) for _ in range(1 + t % 2)]
            shapes.append((kind, [np.round(p * 2) / 2 if t % 4 < 2 else p for p in parts]))
            windows.append((t % 2, 7, 1 + t % 3, 8))
        x0, dx, y0, dy = transform
        got = {(i, r, c) for i, r, a, b in geometry.touched_runs(shapes, np.array(windows), transform).tolist() for c in range(a, b + 1)}
        want = set()
        for i, (c0, c1, r0, r1) in enumerate(windows):
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    x, y = x0 + c * dx, y0 + r * dy
                    if geometry.touches_box(shapes[i], (min(x, x + dx), max(x, x + dx), min(y, y + dy), max(y, y + dy))):
                        want.add((i, r, c))
        assert got == want


def test_clip_keeps_objects_without_cells(spark):
    """A tall polygon in many slices, one around the grid, one outside of it, and none at all."""
    tall = geometry.to_wkb("polygon", [[(1.5, -1), (2.5, -1), (2.5, 999), (1.5, 999), (1.5, -1)]])
    around = geometry.to_wkb("polygon", [[(-9, -9), (9, -9), (9, 1200), (-9, 1200), (-9, -9)], [(-2, -2), (6, -2), (6, 1100), (-2, 1100), (-2, -2)]])
    outside = geometry.to_wkb("point", [[(50, 50)]])
    df = spark.createDataFrame([(1, tall), (2, around), (3, outside), (4, None)], "id int, geom binary")
    df = df.withColumn("_e", geometry.envelope_of(F.col("geom"))).select("id", "geom", "_e.*")
    grid = overlay.Grid(0.0, 1.0, 0.0, 1.0, 4, 1000)
    got = overlay.clipped(df, grid, "geom").select("id", "row", "col").collect()
    assert sorted(map(tuple, got)) == [(1, r, c) for r in range(1000) for c in (1, 2)]
    kept = overlay.clipped(df, grid, "geom", outer=True).select("id", "row", "col")
    assert sorted(map(tuple, kept.where("id > 1").collect())) == [(2, None, None), (3, None, None), (4, None, None)] and kept.count() == 2003
    boxes = overlay.clipped(df.drop("geom"), grid, outer=True).where("id > 2").select("id", "row", "col")
    assert sorted(map(tuple, boxes.collect())) == [(3, None, None), (4, None, None)]


def test_geometry_forms():
    hole = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]}
    shape = geometry.from_geojson(hole)
    assert not geometry.contains(shape, 2, 2) and geometry.contains(shape, 0.5, 2)
    assert not geometry.touches_box(shape, (1.5, 2.5, 1.5, 2.5)) and geometry.touches_box(shape, (4.0, 5.0, 1.0, 2.0))
    line = ("line", [np.array([(0.0, 0.0), (4.0, 4.0)])])
    assert geometry.touches_box(line, (1, 2, 1.5, 1.6)) and not geometry.touches_box(line, (1, 2, 2.5, 3))
    back = geometry.reprojected(geometry.reprojected(shape, "EPSG:4326", "EPSG:3857"), "EPSG:3857", "EPSG:4326")
    assert np.allclose(back[1][0], shape[1][0])
    with pytest.raises(ValueError, match="EPSG:28992"):
        geometry.reprojected(shape, "EPSG:4326", "EPSG:28992")
    assert geometry.from_geojson(geometry.to_geojson(line))[0] == "line"


def test_weights_of_a_box(spark):
    df = spark.createDataFrame([(1, 0.25, 1.25, 0.25, 0.75)], "object_id long, minx double, maxx double, miny double, maxy double")
    got = {(r["row"], r["col"]): r["weight"] for r in overlay.clipped_weights(df, overlay.Grid(0.0, 1.0, 0.0, 1.0, 4, 4), ["object_id"], 10).collect()}
    assert got == {(0, 0): pytest.approx(0.48), (0, 1): pytest.approx(0.18)}


def test_checks(tmp_path):
    with pytest.raises(DataError):
        checks.entries(["hazard.file"], ["hazard.file", r"exposure.geom.file\d+"])
    checks.entries(["exposure.geom.file1"], [r"exposure.geom.file\d+"])
    with pytest.raises(DataError):
        checks.exposure_columns("object_id", ["x"], ["ground_flht"])
    with pytest.raises(DataError):
        checks.derived_types("damage", [], ["_a"])
    with pytest.warns(UserWarning):
        checks.derived_types("damage", ["_a"], ["_b"])
    assert checks.return_periods(["2", "5"], None) == [2.0, 5.0] and checks.return_periods([None, None], [1, 2]) == [1.0, 2.0]
    with pytest.raises(DataError):
        checks.return_periods([None], [1, 2])
    assert checks.band_names(["a"], False, None) == [""] and checks.band_names(["a", "b"], True, [5, 10]) == ["5.0y", "10.0y"]
    for broken in (lambda: checks.no_subsets(["a"], "f"), lambda: checks.has_srs(None, "f"), lambda: checks.unique_columns(["a", "a"]), lambda: checks.grid_curves(["a"], ["b"]), lambda: checks.index_column(["a"], "object_id")):
        with pytest.raises(DataError):
            broken()
    with pytest.raises(FileNotFoundError):
        checks.existing("nothing", tmp_path)
    with pytest.warns(UserWarning):
        assert not checks.extent_within((0, 1, 0, 1), overlay.Grid(0.0, 1.0, 0.0, 1.0, 4, 4))
    with pytest.raises(DataError):
        plugins.hazard_type("fire")


def test_config(tmp_path):
    (tmp_path / "s.toml").write_text('[hazard]\nfile = "h.asc"\n[exposure.geom]\nfile1 = "a"\nfile2 = "b"\n[output]\npath = "out"\n')
    c = Config.from_file(tmp_path / "s.toml")
    assert c.path("hazard.file") == str(tmp_path / "h.asc") and c.numbered("exposure.geom.file") == ["exposure.geom.file1", "exposure.geom.file2"]
    assert c.options("exposure.geom") == {"file1": "a", "file2": "b"} and c.output == str(tmp_path / "out")
    assert [parsed_value(x) for x in ("1", "1.5", "false", "[1, a]", "x")] == [1, 1.5, False, [1, "a"], "x"]


def test_csv(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("#UNIT=m\n#METHOD,mean,max\nwater depth,a,b\n0,0,0\n1,0.5,\n2,1,1\n")
    t = tables.read_csv(spark, str(path))
    assert t.meta == {"unit": "m", "method": ["mean", "max"]} and t.types == {"water depth": "long", "a": "double", "b": "double"}
    assert curves.unpivoted(t.df, "water depth").count() == 6
    tables.write_csv(t.df, str(tmp_path / "out"))
    assert "nan" in "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))


def test_ascii_grid_and_parquet(spark, tmp_path):
    path = tmp_path / "g.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9\n1 2 -9\n4 5 6\n")
    r = rasters.read_raster(spark, str(path))
    assert r.grid == overlay.Grid(10.0, 1.0, 22.0, -1.0, 3, 2)
    want = {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 4.0, (1, 1): 5.0, (1, 2): 6.0}
    assert {(x["row"], x["col"]): x["value"] for x in r.cells.collect()} == want
    rasters.write_raster(r, str(tmp_path / "g.parquet"))
    again = rasters.read_raster(spark, str(tmp_path / "g.parquet"))
    assert again.grid == r.grid and again.cells.count() == 5
    with pytest.raises(DriverError):
        rasters.read_raster(spark, "x.nc")


FEATURES = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"object_id": i, "object_name": f"o{i}"}, "geometry": {"type": "Polygon", "coordinates": [[[10.2 + i, 20.2], [10.8 + i, 20.2], [10.8 + i, 20.8], [10.2 + i, 20.8], [10.2 + i, 20.2]]]}} for i in range(4)]}


def test_vectors(spark, tmp_path):
    path = tmp_path / "v.geojson"
    path.write_text(json.dumps(FEATURES))
    df, srs = vectors.read_vector(spark, str(path))
    assert srs == "EPSG:4326" and df.count() == 4 and vectors.bounds(df) == pytest.approx((10.2, 13.8, 20.2, 20.8))
    vectors.write_vector(df, str(tmp_path / "w.geojsonl"))
    back, _ = vectors.read_vector(spark, str(tmp_path / "w.geojsonl"))
    assert sorted(r["object_id"] for r in back.collect()) == [0, 1, 2, 3]
    db = sqlite3.connect(tmp_path / "v.gpkg")
    db.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT); INSERT INTO gpkg_contents VALUES ('b', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('b', 'geom', 4326); CREATE TABLE b (fid INTEGER PRIMARY KEY, name TEXT, size REAL, geom BLOB)")
    db.execute("INSERT INTO b VALUES (1, 'x', 2.5, ?)", (vectors.header(geometry.to_wkb("point", [[1.0, 2.0]])),))
    db.commit()
    got = vectors.read_vector(spark, str(tmp_path / "v.gpkg"))[0].first()
    assert (got["fid"], got["name"], got["size"], got["minx"], got["maxy"]) == (1, "x", 2.5, 1.0, 2.0)
    with pytest.raises(DriverError):
        vectors.read_vector(spark, "x.shp")


def test_models_end_to_end(spark, tmp_path):
    from tidemark import cli

    (tmp_path / "h.asc").write_text("ncols 4\nnrows 1\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9\n1 2 -9 4\n")
    (tmp_path / "v.geojson").write_text(json.dumps(FEATURES))
    (tmp_path / "c.csv").write_text("water depth,f\n0,0\n5,1\n")
    (tmp_path / "e.csv").write_text("object_id,extract_method,ground_flht,ground_elevtn,fn_damage_s,max_damage_s\n0,area,0,0,f,100\n1,centroid,1,0,f,100\n2,area,0,0,f,100\n3,area,0,0,,100\n3,area,0,0,f,200\n")
    (tmp_path / "s.toml").write_text('[hazard]\nfile = "h.asc"\nelevation_reference = "DEM"\n[vulnerability]\nfile = "c.csv"\n[exposure.geom]\nfile1 = "v.geojson"\n[exposure.csv]\nfile = "e.csv"\n[output]\npath = "out"\n')
    out = geom_model.run(spark, cli.settings(cli.parser().parse_args(["run", str(tmp_path / "s.toml"), "-d", "model.risk=false"])))
    rows = {r["object_id"]: r for r in out["spatial1"].collect()}
    assert rows[0]["damage_s"] == 20.0 and rows[1]["inun_depth"] == 1.0 and rows[1]["total_damage"] == 20.0
    assert rows[2]["damage_s"] is None and rows[2]["total_damage"] == 0.0 and rows[2]["red_fact"] == 0.0
    assert rows[3]["damage_s"] == 160.0  # the last row of a key counts
    assert spark.read.parquet(str(tmp_path / "out/spatial1.parquet")).count() == 4
    assert cli.main(["run", str(tmp_path / "missing.toml")]) == 1 and cli.main(["info"]) == 0


def test_streamed_damage(spark, tmp_path):
    from tidemark.streaming.updates import asset_damages, peak_levels

    events = spark.createDataFrame([("2024-01-01 00:05:00", 0, 0, 1.0), ("2024-01-01 00:15:00", 0, 0, 3.0), ("2024-01-01 03:00:00", 0, 0, 2.0)], "t string, row int, col int, value double").select(F.to_timestamp("t").alias("ts"), "row", "col", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assets = spark.createDataFrame([(7, 0, 0, 0.0, "f", 100.0)], "object_id long, row int, col int, ground_flht double, fn string, max double")
    dense = curves.densified(spark.createDataFrame([("f", 0.0, 0.0), ("f", 5.0, 1.0)], "fn string, depth double, fraction double"))
    q = asset_damages(peak_levels(stream), assets, dense).writeStream.outputMode("append").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["damage"] for r in spark.table("streamed").collect()] == [60.0]


def test_jobs():
    from tidemark.plans.config import jobs

    assert len(jobs({"a": [1, 2], "b": [1, 2]})) == 4 and len(jobs({"a": [1, 2], "b": [1, 2, 3], "c": [1, 2, 3]})) == 18
    assert len(jobs({"a": [1, 2], "b": [1, 2, 3], "c": [4, 5, 6]}, ("b", "c"))) == 6


def test_repeated_and_null_ids(spark):
    """Features are assessed one by one, whatever their object_id; equal features have equal results."""
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 3.0)], "band int, row int, col int, value double")
    dense = curves.densified(spark.createDataFrame([("f", 0.0, 0.0), ("f", 5.0, 1.0)], "fn string, depth double, fraction double"))
    rows = [(1, "centroid", 0.0, 0.0, "f", 100.0, 0.5, 0.5), (1, "centroid", 0.0, 0.0, "f", 100.0, 1.5, 0.5), (None, "centroid", 0.0, 0.0, "f", 100.0, 1.5, 0.5), (1, "centroid", 0.0, 0.0, "f", 100.0, 0.5, 0.5)]
    assets = spark.createDataFrame(rows, "object_id long, extract_method string, ground_flht double, ground_elevtn double, fn_damage_s string, max_damage_s double, x double, y double")
    assets = assets.withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")})
    out = geom_model.impact(assets, rasters.Raster(cells, overlay.Grid(0, 1, 0, 1, 2, 1)), dense, [""])
    got = sorted((str(r["object_id"]), r["x"], r["damage_s"], r["total_damage"]) for r in out.collect())
    assert got == [("1", 0.5, 20.0, 20.0), ("1", 0.5, 20.0, 20.0), ("1", 1.5, 60.0, 60.0), ("None", 1.5, 60.0, 60.0)]


def test_csv_header_after_many_comments(spark, tmp_path):
    (tmp_path / "c.csv").write_text("".join(f"#K{i}={i}\n" for i in range(500)) + "a,b\n1,x\n#late=1\n2,y\n")
    t = tables.read_csv(spark, str(tmp_path / "c.csv"))
    assert len(t.meta) == 500 and t.meta["k499"] == "499" and t.df.columns == ["a", "b"] and t.df.count() == 2


def test_srs_is_stored(spark, tmp_path):
    df = vectors.with_envelope(spark.createDataFrame([(1, bytearray(geometry.to_wkb("point", [[1.0, 2.0]])))], "object_id long, geom binary"))
    for name in ("v.parquet", "v.geojsonl"):
        vectors.write_vector(df, str(tmp_path / name), srs="EPSG:3857")
        assert vectors.read_vector(spark, str(tmp_path / name))[1] == "EPSG:3857"
    vectors.write_vector(df, str(tmp_path / "u.parquet"))
    srs = vectors.read_vector(spark, str(tmp_path / "u.parquet"))[1]
    with pytest.raises(DataError):
        checks.has_srs(srs, "u.parquet")
    assert vectors.read_vector(spark, str(tmp_path / "u.parquet"), srs="EPSG:4326")[1] == "EPSG:4326"


def test_step_size(tmp_path):
    from tidemark.plans.config import table_decimals

    assert table_decimals({}) == 2 and table_decimals({"vulnerability.step_size": 0.001}) == 3 and table_decimals({"vulnerability.round": 1}) == 1
    with pytest.raises(DataError):
        table_decimals({"vulnerability.step_size": 0.02})
    c = Config({"hazard": {"file": "none.asc"}}, tmp_path)
    with pytest.raises(FileNotFoundError):
        checks.existing_entries(c, ["hazard.file"])


def test_grid_model_end_to_end(spark, tmp_path):
    """From GeoTIFF files: curves, names and systems of the files; results that can be read back."""
    from tidemark.plans import grid_model

    exposed, water = np.full((4, 3), 100.0), np.arange(12, dtype=float).reshape(4, 3)
    water[0, 0] = -9
    (tmp_path / "e.tif").write_bytes(_tiff(exposed, True, '<GDALMetadata><Item name="fn_damage" sample="0">f</Item></GDALMetadata>', 28992))
    (tmp_path / "h.tif").write_bytes(_tiff(water, False, '<GDALMetadata><Item name="return_period" sample="0">10</Item><Item name="x" sample="0" role="description">deep</Item></GDALMetadata>', 28992))
    (tmp_path / "c.csv").write_text("water depth,f\n0,0\n20,1\n")
    h = rasters.read_raster(spark, str(tmp_path / "h.tif"))
    assert h.grid.srs == "EPSG:28992" and h.names == ["deep"] and h.meta == [{"return_period": "10"}]
    settings = {"hazard": {"file": "h.tif"}, "vulnerability": {"file": "c.csv"}, "exposure": {"grid": {"file": "e.tif"}}, "output": {"path": "out"}, "model": {"risk": True}}
    grid_model.run(spark, Config(settings, tmp_path))
    want = {(r, c): water[r, c] * 5.0 for r in range(4) for c in range(3) if water[r, c] != -9}
    for name, factor, bands in (("damage", 1.0, ["damage1_10.0y"]), ("total", 1.0, ["total_10.0y"]), ("ead", 0.1, ["ead"])):
        back = rasters.read_raster(spark, str(tmp_path / f"out/{name}.parquet"))
        assert back.grid == h.grid and back.names == bands
        assert {(x["row"], x["col"]): x["value"] for x in back.cells.collect()} == pytest.approx({k: v * factor for k, v in want.items()})
    (tmp_path / "e.asc").write_text("ncols 3\nnrows 4\nxllcorner 10\nyllcorner 18\ncellsize 0.5\n" + "100 100 100\n" * 4)
    settings["exposure"]["grid"] = {"file": "e.asc", "srs": "EPSG:28992", "fn_damage": "f"}
    out = grid_model.run(spark, Config(settings, tmp_path))
    assert out["total"].count() == len(want)


def _tiff(values, deflate, metadata="", code=0):
    """A one-band float32 file with strips of two rows."""
    import struct
    import zlib

    h, w = values.shape
    strips = [values[i : i + 2].astype("<f4").tobytes() for i in range(0, h, 2)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    n, head = len(strips), 8
    extra = head + sum(map(len, strips))
    offsets = [head + sum(map(len, strips[:i])) for i in range(n)]
    scale, tie, nodata = struct.pack("<3d", 0.5, 0.5, 0), struct.pack("<6d", 0, 0, 0, 10, 20, 0), b"-9\0\0"
    blob, places = b"", {}
    for name, data in (("o", struct.pack(f"<{n}I", *offsets)), ("s", struct.pack(f"<{n}I", *map(len, strips))), ("scale", scale), ("tie", tie), ("keys", struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, code)), ("meta", metadata.encode() + b"\0")):
        places[name] = extra + len(blob)
        blob += data
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, n, places["o"]), (277, 3, 1, 1), (278, 4, 1, 2), (279, 4, n, places["s"]), (339, 3, 1, 3), (33550, 12, 3, places["scale"]), (33922, 12, 6, places["tie"]), (42113, 2, 3, struct.unpack("<I", nodata)[0])]
    tags = sorted(tags + ([(34735, 3, 8, places["keys"])] if code else []) + ([(42112, 2, len(metadata) + 1, places["meta"])] if metadata else []))
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    return struct.pack("<2sHI", b"II", 42, extra + len(blob)) + b"".join(strips) + blob + directory


@pytest.mark.parametrize("deflate", [False, True])
def test_geotiff(spark, tmp_path, deflate):
    values = np.arange(15, dtype=float).reshape(5, 3)
    values[1, 1] = -9
    (tmp_path / "g.tif").write_bytes(_tiff(values, deflate))
    r = rasters.read_raster(spark, str(tmp_path / "g.tif"))
    assert r.grid == overlay.Grid(10.0, 0.5, 20.0, -0.5, 3, 5)
    got = {(x["row"], x["col"]): x["value"] for x in r.cells.collect()}
    assert got == {(i, j): values[i, j] for i in range(5) for j in range(3) if values[i, j] != -9}
