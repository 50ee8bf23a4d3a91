"""Objects on grids. A grid is a table of cells (band, row, col, value) and its transform x0, dx, y0, dy; all joins are equi-joins on cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry


@dataclass(frozen=True)
class Grid:
    """Upper-left corner, cell sizes (dy is negative for north-up grids) and shape."""

    x0: float
    dx: float
    y0: float
    dy: float
    width: int
    height: int
    srs: str = "EPSG:4326"

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = sorted((self.x0, self.x0 + self.dx * self.width)), sorted((self.y0, self.y0 + self.dy * self.height))
        return xs[0], xs[1], ys[0], ys[1]


def pixel_of(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row) of a point."""
    return F.floor((x - grid.x0) / grid.dx).cast("int"), F.floor((y - grid.y0) / grid.dy).cast("int")


def corner_of(grid: Grid, col: Column, row: Column) -> tuple[Column, Column]:
    """World coordinates of a cell's upper-left corner."""
    return grid.x0 + col * grid.dx, grid.y0 + row * grid.dy


def inside(grid: Grid, col: Column, row: Column) -> Column:
    return (col >= 0) & (col < grid.width) & (row >= 0) & (row < grid.height)


def pinned(objects: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Adds row and col of the object's point; NULL outside the grid."""
    col, row = pixel_of(grid, F.col(x), F.col(y))
    ok = inside(grid, col, row)
    return objects.withColumn("col", F.when(ok, col)).withColumn("row", F.when(ok, row))


def window_of(grid: Grid) -> list[Column]:
    """c0, c1, r0, r1 of an envelope (minx, maxx, miny, maxy) within the grid; touching counts. Empty where c0 > c1 or r0 > r1."""
    us = [(F.col("minx") - grid.x0) / grid.dx, (F.col("maxx") - grid.x0) / grid.dx]
    vs = [(F.col("miny") - grid.y0) / grid.dy, (F.col("maxy") - grid.y0) / grid.dy]
    first = lambda c: F.greatest((F.ceil(F.least(*c)) - 1).cast("int"), F.lit(0))
    last = lambda c, n: F.least(F.floor(F.greatest(*c)).cast("int"), F.lit(n - 1))
    return [first(us), last(us, grid.width), first(vs), last(vs, grid.height)]


#: Rows of cells that one call looks at: a geometry is copied once for each, so that a very tall one isn't a single piece of work.
SLICE_ROWS = 256


def clipped(objects: DataFrame, grid: Grid, geom: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each cell that the object touches; with outer, a row with NULL row and col for an object that touches none.

    Without a geometry column the envelope is the object. Else WKB goes to Python once for each SLICE_ROWS rows and comes back as runs of
    cells, which are expanded in the JVM: no geometry is sent or kept for a cell.
    """
    explode = F.explode_outer if outer else F.explode
    c0, c1, r0, r1 = window_of(grid)
    # least and greatest pass over NULLs, so an envelope with one would be the whole grid
    some = (c0 <= c1) & (r0 <= r1) & (F.col("minx") + F.col("maxx") + F.col("miny") + F.col("maxy")).isNotNull()
    span = lambda a, b, *step: F.when(some, F.sequence(a, b, *step)).otherwise(F.array().cast("array<int>"))
    if geom is None:
        return objects.withColumn("col", explode(span(c0, c1))).withColumn("row", explode(span(r0, r1)))
    sliced = objects.withColumn("_slice", explode(span(r0, r1, F.lit(SLICE_ROWS))))
    runs = geometry.runs_of(F.col(geom), [c0, c1, r0, r1], (grid.x0, grid.dx, grid.y0, grid.dy), F.col("_slice"), SLICE_ROWS, outer)
    found = sliced.withColumn("_run", F.explode(runs)).withColumn("row", F.col("_run.row"))
    cols = F.when(F.col("_run.c0").isNotNull(), F.sequence("_run.c0", "_run.c1"))
    return found.withColumn("col", explode(cols)).drop("_slice", "_run")


def clipped_weights(objects: DataFrame, grid: Grid, keys: list[str], upscale: int = 10, geom: str | None = None) -> DataFrame:
    """keys, row, col, weight: share of the cell's upscale^2 sub-cells that the object touches."""
    fine = Grid(grid.x0, grid.dx / upscale, grid.y0, grid.dy / upscale, grid.width * upscale, grid.height * upscale, grid.srs)
    cells = clipped(objects, fine, geom)
    cell = lambda c: F.floor(F.col(c) / upscale).cast("int").alias(c)
    return cells.groupBy(*keys, cell("row"), cell("col")).agg((F.count(F.lit(1)).cast("double") / float(upscale * upscale)).alias("weight"))


def sampled(cells: DataFrame, grid_cells: DataFrame, bands: DataFrame) -> DataFrame:
    """Cells of objects with each band's value; a cell without data keeps its row, with a NULL value, and an object without cells keeps one row for each band."""
    have = cells.where(F.col("col").isNotNull())
    # the bands of a grid are few; the cross with them is the output's size
    joined = have.crossJoin(F.broadcast(bands)).join(grid_cells.select("band", "row", "col", "value"), ["band", "row", "col"], "left")
    none = cells.where(F.col("col").isNull()).crossJoin(F.broadcast(bands)).withColumn("value", F.lit(None).cast("double"))
    return joined.withColumn("cell", F.lit(1)).unionByName(none.withColumn("cell", F.lit(None).cast("int")))
