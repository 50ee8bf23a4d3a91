"""Grids: parquet in long form (band, row, col, value) with a metadata file, and ESRI ASCII grids."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DriverError
from ..functions.scalars import without_nodata
from ..operators.overlay import Grid
from .geotiff import read_geotiff


@dataclass
class Raster:
    cells: DataFrame
    grid: Grid
    names: list[str] = field(default_factory=list)
    meta: list[dict[str, str]] = field(default_factory=list)

    def item(self, band: int, key: str) -> str:
        """Metadata of a band (from 1); `None` as text if it's missing."""
        return str(self.meta[band - 1].get(key)) if band <= len(self.meta) else "None"


def band_names(descriptions: list[str | None], meta: list[dict[str, str]]) -> list[str]:
    """Description, else variable name, else band<n>."""
    out = []
    for i, d in enumerate(descriptions):
        var = next((v for k, v in (meta[i] if i < len(meta) else {}).items() if "VARNAME" in k.upper()), None)
        out.append(d or var or f"band{i + 1}")
    return out


def read_raster(spark: SparkSession, path: str, srs: str | None = None) -> Raster:
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix in (".asc", ".agr", ".txt"):
        return read_ascii(spark, path, srs or "EPSG:4326")
    if suffix in (".tif", ".tiff"):
        cells, lay = read_geotiff(spark, path, srs)
        return Raster(cells, lay.grid, band_names(list(lay.names), list(lay.meta)) if lay.bands > 1 or lay.names[0] else [""], list(lay.meta))
    if suffix in (".parquet", ""):
        info = json.loads("".join(r[0] for r in spark.read.text(path.rstrip("/") + ".json").collect()))
        grid = Grid(**info["grid"]) if srs is None else Grid(**info["grid"] | {"srs": srs})
        return Raster(spark.read.parquet(path), grid, info["names"], info["meta"])
    raise DriverError("grid", path)


def read_ascii(spark: SparkSession, path: str, srs: str = "EPSG:4326") -> Raster:
    """One band; six header lines, then a line for each row."""
    lines = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id())
    head = {}
    for r in lines.limit(6).collect():
        parts = r["value"].split()
        if parts and parts[0][0].isalpha():
            head[parts[0].lower()] = float(parts[1])
    size, ncols, nrows = head["cellsize"], int(head["ncols"]), int(head["nrows"])
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    low = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
    grid = Grid(x0, size, low + size * nrows, -size, ncols, nrows, srs)
    body = lines.where(~F.trim("value").rlike("^[A-Za-z]")).where("trim(value) <> ''")
    # a line's row is its place among the lines: counted per partition, so no exchange of the cells
    parts = body.withColumn("_p", F.shiftright("_i", 33))
    firsts = sorted((r["_p"], r["a"], r["n"]) for r in parts.groupBy("_p").agg(F.min("_i").alias("a"), F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, a, n in firsts:
        starts.append((p, a, total))
        total += n
    placed = parts.join(F.broadcast(spark.createDataFrame(starts or [(0, 0, 0)], "_p long, _a long, _s long")), "_p")
    cells = placed.select((F.col("_i") - F.col("_a") + F.col("_s")).cast("int").alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    value = without_nodata(F.col("v").cast("double"), head.get("nodata_value"))
    return Raster(cells.select(F.lit(1).alias("band"), "row", "col", value.alias("value")).where("value IS NOT NULL"), grid, [""], [{}])


def write_raster(raster: Raster, path: str) -> None:
    """Cells partitioned by band, and the metadata beside them."""
    spark = raster.cells.sparkSession
    raster.cells.write.mode("overwrite").partitionBy("band").parquet(path)
    text = json.dumps({"grid": asdict(raster.grid), "names": raster.names, "meta": raster.meta})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".json")


def long_form(columns: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """(band, row, col, value) from one column for each band."""
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("band"), without_nodata(F.col(b), nodata).alias("value")) for i, b in enumerate(bands)])
    return columns.select("row", "col", F.explode(pairs).alias("p")).select("p.band", "row", "col", "p.value").where("value IS NOT NULL")
