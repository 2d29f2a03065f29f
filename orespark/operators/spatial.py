"""Points: envelopes, the nearest neighbour within a radius, and labels by distance. Distances are joined by equal cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXCLUDED_TO_M, NEAREST_M, POSITIVE_BUFFER_M
from ..functions.columns import col
from ..functions.crs import to_xy

#: Places that a cell may hold before cells are halved, and how often they are halved at most.
CELL_PLACES, DEEPEST = 16, 40


def project(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with x and y in the target CRS."""
    x, y = to_xy(lon, lat)
    return df.withColumn("x", x).withColumn("y", y)


def in_bbox(x, y, box: tuple[float, float, float, float]) -> Column:
    return col(x).between(box[0], box[2]) & col(y).between(box[1], box[3])


def bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("x_min"), F.min(y).alias("y_min"), F.max(x).alias("x_max"), F.max(y).alias("y_max"))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, dist) of all pairs within radius. Each point of the smaller side meets the 3 x 3 cells around it, so the
    join is on equal cells. left and right: id, x, y; points without a place meet none."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("ci"), (cell("y") + j).alias("cj")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a, b = (df.where("x is not null and y is not null").select(F.col(c).alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), "x", "y") for df, c, s in ((left, left_id, "l"), (right, right_id, "r")))
    many = left.count() > right.count()
    a, b = (df.withColumn("c", around if wide else F.struct(cell("x").alias("ci"), cell("y").alias("cj"))).drop("x", "y") for df, wide in ((a, not many), (b, many)))
    dist = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    return a.join(b, "c").where(dist <= radius).select(F.col("l").alias(left_id), F.col("r").alias(right_id), dist.alias("dist"))


def cell_at(level: int, radius: float, names: tuple[str, str]) -> list[Column]:
    """The cell that x and y lie in, radius / 2 ** level wide."""
    return [F.floor(F.col(c) / (radius / 2**level)).alias(n) for c, n in zip(("x", "y"), names)]


def depth(sites: DataFrame, radius: float) -> int:
    """How often cells are halved until none holds more than CELL_PLACES sites; a halving leaves a fourth of them at least."""
    level = 0
    while level < DEEPEST:
        most = sites.groupBy(*cell_at(level, radius, ("i", "j"))).count().agg(F.max("count")).first()[0] or 0
        if most <= CELL_PLACES:
            break
        level = min(DEEPEST, level + max(1, math.ceil(math.log(most / CELL_PLACES, 4) - 1e-9)))
    return level


def nearest_places(places: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """(x, y, dist, id) of the nearest site (x, y, id) within radius of each place (x, y), the lowest id of equals. Cells as wide as
    the radius are halved level by level; a cell stays with a place only if it may hold a site as near as the farthest corner of
    another one, so a place meets a few sites, however many lie within radius."""
    levels = depth(sites, radius)
    left = places.select("x", "y", F.lit(float(radius)).alias("bound"), *cell_at(0, radius, ("up_i", "up_j")))
    gap = F.hypot(*[F.greatest(F.col(f"{c}0") - F.col(c), F.lit(0.0), F.col(c) - F.col(f"{c}1")) for c in ("x", "y")])
    reach = F.hypot(*[F.greatest(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(c)) for c in ("x", "y")])
    may = F.col("gap") <= F.col("bound") * (1 + 1e-9)
    for level in range(levels + 1):
        held = sites.groupBy(*cell_at(level, radius, ("i", "j"))).agg(*[f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))])
        if level:
            held = held.withColumns({"up_i": F.floor(F.col("i") / 2), "up_j": F.floor(F.col("j") / 2)})
        else:
            for c in ("i", "j"):
                held = held.withColumn(f"up_{c}", F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
        left = left.join(held, ["up_i", "up_j"]).withColumn("gap", gap).where(may)
        left = left.withColumn("bound", F.least("bound", F.min(reach).over(Window.partitionBy("x", "y")))).where(may)
        left = left.select("x", "y", "bound", F.col("i").alias("up_i"), F.col("j").alias("up_j"))
    met = left.join(sites.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), *cell_at(levels, radius, ("up_i", "up_j"))), ["up_i", "up_j"])
    met = met.withColumn("dist", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("dist") <= radius)
    return met.groupBy("x", "y").agg(F.min(F.struct("dist", "id")).alias("m")).select("x", "y", "m.dist", "m.id")


def nearest_join(left: DataFrame, right: DataFrame, *, radius: float = NEAREST_M, left_id: str, right_id: str) -> DataFrame:
    """left with the id and distance of its nearest right point within radius, NULL if there is none; the lowest id of equals. Points
    at one place are looked up once."""
    placed = [df.where((F.abs("x") < math.inf) & (F.abs("y") < math.inf)) for df in (left, right)]
    near = nearest_places(placed[0].select("x", "y").distinct(), placed[1].groupBy("x", "y").agg(F.min(right_id).alias("id")), radius)
    return left.join(near.select("x", "y", F.col("id").alias(right_id), "dist"), ["x", "y"], "left").select(*left.columns, right_id, "dist")


def label_by_distance(points: DataFrame, positives: DataFrame, negatives: DataFrame, *, point_id: str, site_id: str, near: float = POSITIVE_BUFFER_M, far: float = EXCLUDED_TO_M) -> DataFrame:
    """points with nearest_positive, nearest_negative and label: 1 within ``near`` of a positive site; NULL between that and
    ``far`` (excluded); else 0 within ``near`` of a negative site; else NULL."""
    pos = near_pairs(points, positives, far, point_id, site_id).groupBy(point_id).agg(F.min("dist").alias("nearest_positive"))
    neg = near_pairs(points, negatives, near, point_id, site_id).groupBy(point_id).agg(F.min("dist").alias("nearest_negative"))
    label = F.when(F.col("nearest_positive") <= near, 1).when(F.col("nearest_positive") <= far, None).when(F.col("nearest_negative") <= near, 0)
    return points.join(pos, point_id, "left").join(neg, point_id, "left").withColumn("label", label)
