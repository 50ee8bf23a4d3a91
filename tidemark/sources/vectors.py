"""Vector files: GeoJSON and GeoPackage to a table of attributes, WKB and envelope, and writers. Parquet with WKB is the native form."""

from __future__ import annotations

import json
import sqlite3
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..errors import DataError, DriverError
from ..operators import geometry

READERS = (".geojson", ".json", ".geojsonl", ".gpkg", ".parquet")


def read_vector(spark: SparkSession, path: str, layer: str | None = None, srs: str | None = None) -> tuple[DataFrame, str | None]:
    """(table with `geom` and minx, maxx, miny, maxy, its coordinate system). srs, if given, replaces what the file says."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
        return (df if "minx" in df.columns else with_envelope(df)), srs or stored_srs(spark, path)
    if suffix in (".geojson", ".json", ".geojsonl"):
        df, own = read_geojson(spark, path)
        return df, srs or (stored_srs(spark, path, own) if suffix == ".geojsonl" else own)
    if suffix == ".gpkg":
        df, own = read_gpkg(spark, path, layer)
        return df, srs or own
    raise DriverError("vector", path)


def stored_srs(spark: SparkSession, path: str, default: str | None = None) -> str | None:
    """The system that write_vector stored beside a table, for forms that can't hold it."""
    try:
        return spark.read.text(path.rstrip("/") + ".srs").first()[0]
    except AnalysisException:
        return default


def with_envelope(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumn("_e", geometry.envelope_of(F.col(geom))).select("*", "_e.*").drop("_e")


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A FeatureCollection in one document, or one Feature a line (read in parallel)."""
    if path.endswith(".geojsonl"):
        lines = spark.read.text(path).where("trim(value) <> ''").withColumnRenamed("value", "f")
        srs = "EPSG:4326"
    else:
        # one JSON document isn't split; its features are exploded in the scan
        doc = spark.read.text(path, wholetext=True)
        crs = doc.select(F.get_json_object("value", "$.crs.properties.name")).first()[0]
        srs = "EPSG:" + crs.rsplit(":", 1)[1] if crs and "EPSG" in crs else "EPSG:4326"
        lines = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    parts = lines.select(F.get_json_object("f", "$.properties").alias("p"), F.get_json_object("f", "$.geometry").alias("g"))
    sample = parts.select("p").where("p IS NOT NULL")
    schema = spark.read.json(sample.select(F.col("p").alias("value")).rdd.map(lambda r: r[0])).schema if not sample.isEmpty() else None
    df = parts.withColumn("geom", geometry.wkb_of_geojson(F.col("g")))
    if schema is not None and schema.fields:
        df = df.withColumn("_p", F.from_json("p", schema)).select("_p.*", "geom")
    else:
        df = df.select("geom")
    return with_envelope(df), srs


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> tuple[DataFrame, str]:
    """A GeoPackage layer, through sqlite3 in a task for each range of rows."""
    db = sqlite3.connect(path)
    try:
        layers = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features'")]
        layer = layer or (layers[0] if layers else None)
        if layer not in layers:
            raise DataError(f"{path} has no layer {layer}")
        column, srs_id = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        info = [(r[1], (r[2] or "").upper()) for r in db.execute(f'PRAGMA table_info("{layer}")')]
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{layer}"').fetchone()
    finally:
        db.close()
    kinds = {c: "bigint" if "INT" in t else "double" if any(x in t for x in ("REAL", "DOUBLE", "FLOAT")) else "string" for c, t in info if c != column}
    names = list(kinds)
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", geom binary"
    if low is None:
        return with_envelope(spark.createDataFrame([], schema)), f"EPSG:{srs_id}"
    step = 50_000
    starts = spark.range(low, high + 1, step, max(1, (high - low) // step + 1))

    def rows(batches):
        import pandas as pd

        own = sqlite3.connect(path)
        try:
            for batch in batches:
                for start in batch["id"]:
                    query = f'SELECT {", ".join(chr(34) + c + chr(34) for c in [*names, column])} FROM "{layer}" WHERE rowid >= ? AND rowid < ?'
                    got = own.execute(query, (int(start), int(start) + step)).fetchall()
                    yield pd.DataFrame([(*r[:-1], gpkg_wkb(r[-1])) for r in got], columns=[*names, "geom"])
        finally:
            own.close()

    return with_envelope(starts.mapInPandas(rows, schema)), f"EPSG:{srs_id}"


def layers(path: str) -> list[str]:
    """Names of a GeoPackage's feature layers."""
    db = sqlite3.connect(path)
    try:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY 1")]
    finally:
        db.close()


def merged(parts: list[DataFrame]) -> DataFrame:
    """One layer of several, by column names; file_idx tells where a row comes from."""
    out = None
    for i, df in enumerate(parts, 1):
        df = df.withColumn("file_idx", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The WKB after a GeoPackage header."""
    if blob is None:
        return None
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
    return bytes(blob[8 + envelope :])


def write_geojson(df: DataFrame, path: str, geom: str = "geom", mode: str = "overwrite") -> None:
    """One Feature a line, in parallel."""
    columns = [c for c in df.columns if c not in (geom, "minx", "maxx", "miny", "maxy")]

    @F.pandas_udf("string")
    def shape(g):
        return g.map(lambda x: None if x is None else json.dumps(geometry.to_geojson(geometry.from_wkb(x))))

    feature = F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(*columns)), F.lit(', "geometry": '), F.coalesce(shape(geom), F.lit("null")), F.lit("}"))
    df.select(feature.alias("value")).write.mode(mode).text(path)


def write_vector(df: DataFrame, path: str, mode: str = "overwrite", srs: str | None = None) -> None:
    """By suffix; `append` adds to a layer. The system, if given, is stored beside the table."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if srs:
        df.sparkSession.createDataFrame([(srs,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".srs")
    if suffix in (".geojson", ".geojsonl", ".json"):
        write_geojson(df, path, mode=mode)
    elif suffix in (".parquet", ""):
        df.write.mode(mode).parquet(path)
    else:
        raise DriverError("vector output", path)


def bounds(df: DataFrame) -> tuple[float, float, float, float] | None:
    r = df.agg(F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")).first()
    return None if r[0] is None else tuple(r)


def header(blob: bytes) -> bytes:
    """A GeoPackage header without envelope for WKB."""
    return b"GP\x00\x01" + struct.pack("<i", 4326) + blob
