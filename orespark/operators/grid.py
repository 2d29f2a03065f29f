"""Grids as rows (band, row, col, value): building, sampling, warping, checking."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RESOLUTION_M, TILE, GridMeta
from ..functions.crs import to_lonlat, to_xy
from .quantiles import quantiles


def grid_over(box: tuple[float, float, float, float], resolution: float = RESOLUTION_M) -> GridMeta:
    """The grid of whole cells that covers a box."""
    return GridMeta(box[0], box[3], resolution, resolution, math.ceil((box[2] - box[0]) / resolution), math.ceil((box[3] - box[1]) / resolution))


def build_grid(spark: SparkSession, meta: GridMeta, at: str = "centre") -> DataFrame:
    """cell_id, row, col, x, y: row by row from the top; at the cells' centres, or their top-left corners (at="corner")."""
    off = 0.5 if at == "centre" else 0.0
    cells = spark.range(meta.width * meta.height).select(F.col("id").alias("cell_id"), F.expr(f"int(id div {meta.width})").alias("row"), F.expr(f"int(id % {meta.width})").alias("col"))
    return cells.withColumn("x", meta.x0 + (F.col("col") + F.lit(off)) * meta.dx).withColumn("y", meta.y0 - (F.col("row") + F.lit(off)) * meta.dy)


def cell_of(df: DataFrame, meta: GridMeta, x: str = "x", y: str = "y") -> DataFrame:
    """df with the row and col of the cell that each point lies in."""
    return df.withColumn("row", F.floor((F.lit(meta.y0) - F.col(y)) / meta.dy).cast("int")).withColumn("col", F.floor((F.col(x) - F.lit(meta.x0)) / meta.dx).cast("int"))


def sample_points(points: DataFrame, cells: DataFrame, meta: GridMeta, point_id: str) -> DataFrame:
    """(point_id, band, value) of the cell below each point; nothing outside the grid or without a value."""
    return cell_of(points, meta).join(cells, ["row", "col"]).where("value is not null").select(point_id, "band", "value")


def sample_wide(points: DataFrame, cells: DataFrame, meta: GridMeta, bands: list[str]) -> DataFrame:
    """points with a column for each band, NULL where it has none. The bands' values are put side by side for each cell in the box
    that holds all points, so points meet them once."""
    at = cell_of(points, meta)
    box = at.agg(*[f(c).alias(f"_{k}_{c}") for c in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))])
    inside = F.col("row").between(F.col("_lo_row"), F.col("_hi_row")) & F.col("col").between(F.col("_lo_col"), F.col("_hi_col"))
    wide = cells.where(F.col("band").isin(bands)).join(F.broadcast(box), inside).groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])
    return at.join(wide, ["row", "col"], "left").select(*points.columns, *bands)


def warp_bilinear(cells: DataFrame, source: GridMeta, target: DataFrame) -> DataFrame:
    """(cell_id, band, value): the weighted mean of the four source cells around each target cell's centre, over those that have
    a value; NULL if none has. target: cell_id, x, y in the source's CRS."""
    at = target.withColumn("fr", (F.lit(source.y0) - F.col("y")) / source.dy - 0.5).withColumn("fc", (F.col("x") - F.lit(source.x0)) / source.dx - 0.5)
    at = at.withColumn("r0", F.floor("fr")).withColumn("c0", F.floor("fc")).withColumn("tr", F.col("fr") - F.col("r0")).withColumn("tc", F.col("fc") - F.col("c0"))
    corner = lambda i, j: F.struct((F.col("r0") + i).cast("int").alias("row"), (F.col("c0") + j).cast("int").alias("col"), ((F.col("tr") if i else 1 - F.col("tr")) * (F.col("tc") if j else 1 - F.col("tc"))).alias("w"))
    four = at.select("cell_id", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("k")).select("cell_id", "k.*").where("w > 0")
    seen = F.col("value").isNotNull()
    mean = F.try_divide(F.sum(F.when(seen, F.col("w") * F.col("value"))), F.sum(F.when(seen, F.col("w"))))
    return four.join(cells, ["row", "col"]).groupBy("cell_id", "band").agg(mean.alias("value"))


def projected_grid(spark: SparkSession, source: GridMeta, resolution: float = RESOLUTION_M, steps: int = 20) -> GridMeta:
    """The grid in the target CRS that holds a source grid in degrees: its edge, each side in ``steps`` parts, is projected."""
    x1, y1 = source.x0 + source.width * source.dx, source.y0 - source.height * source.dy
    part = [k / steps for k in range(steps + 1)]
    edge = [p for t in part for p in ((source.x0 + t * (x1 - source.x0), source.y0), (source.x0 + t * (x1 - source.x0), y1), (source.x0, y1 + t * (source.y0 - y1)), (x1, y1 + t * (source.y0 - y1)))]
    x, y = to_xy("lon", "lat")
    box = spark.createDataFrame(edge, "lon double, lat double").select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return grid_over(tuple(box), resolution)


def reproject(cells: DataFrame, source: GridMeta, target: GridMeta) -> DataFrame:
    """(band, row, col, value) of the target grid from cells of a source grid in degrees: each target cell's centre is taken back to
    degrees, and read there by bilinear means. Target cells that touch no source cell have no row."""
    spark = cells.sparkSession
    at = build_grid(spark, target)
    lon, lat = to_lonlat("x", "y")
    back = at.select("cell_id", lon.alias("lon"), lat.alias("lat")).withColumnsRenamed({"lon": "x", "lat": "y"})
    warped = warp_bilinear(cells, source, back)
    return warped.select("band", F.expr(f"int(cell_id div {target.width})").alias("row"), F.expr(f"int(cell_id % {target.width})").alias("col"), "value")


def validate(cells: DataFrame) -> DataFrame:
    """n_cells, n_valid, min, max, valid for each band: a raster without any value is not valid."""
    return cells.groupBy("band").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_valid"), F.min("value").alias("min"), F.max("value").alias("max")).withColumn("valid", F.col("n_valid") > 0)


def band_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy("band").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_valid"))


def percentile_limits(cells: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Display limits of each band: exact percentiles, and the symmetric range around 0 that holds them."""
    p = quantiles(cells, ["band"], "value", [low, high]).withColumnsRenamed({"q0": "lo", "q1": "hi"})
    return p.withColumn("limit", F.greatest(F.abs("lo"), F.abs("hi")))


def with_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    return cells.withColumn("tile_r", F.expr(f"int(row div {size})")).withColumn("tile_c", F.expr(f"int(col div {size})"))
