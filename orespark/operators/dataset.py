"""Training sets: imputing, scaling, oversampling, weights, folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FOLDS
from ..functions.columns import strip, with_missing
from .quantiles import quantiles

#: Rows of the minority that meet each other in one task, and queries that are compared at once.
KNN_BLOCK, KNN_QUERIES = 5000, 256
#: Ranges that rows are numbered by.
RANGES = 256


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")
    found = {r.name: r.q0 for r in quantiles(df.select(values).select("v.*"), ["name"], "value", [0.5]).collect()}
    return df.sparkSession.createDataFrame([tuple(found.get(c) for c in columns)], ", ".join(f"`{c}` double" for c in columns))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with its rows numbered from 0 by a numeric key without ties: within ranges of it, and the ranges, whose number is
    bounded, after each other."""
    cuts = sorted(set(df.stat.approxQuantile(key, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    ranged = df.withColumn("_range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(key)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("long")).drop("_range", "_start")


def impute(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    renamed = fitted.select(*[F.col(c).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(renamed)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population deviation; by 1 if it is 0."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns])


def strip_folds(df: DataFrame, n: int = FOLDS, x: str = "x") -> DataFrame:
    limits = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.crossJoin(F.broadcast(limits)).withColumn("fold", strip(x, "_lo", "_hi", n)).drop("_lo", "_hi")


def grid_folds(df: DataFrame, n: int = FOLDS) -> DataFrame:
    """Blocks of an n x n grid, dealt to n folds so that neighbours differ."""
    limits = df.agg(*[f(c).alias(f"_{k}{c}") for c in ("x", "y") for k, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(limits)).withColumn("block_x", strip("x", "_lox", "_hix", n)).withColumn("block_y", strip("y", "_loy", "_hiy", n))
    return out.withColumn("fold", F.expr(f"int((block_x + 2 * block_y) % {n})")).drop("_lox", "_hix", "_loy", "_hiy")


def round_robin_folds(df: DataFrame, position: str, n: int = FOLDS) -> DataFrame:
    """Folds by a position that numbers the rows from 0."""
    return df.withColumn("fold", F.expr(f"int(pmod({position}, {n}))"))


def split(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; synthetic rows only train."""
    return df.where(F.coalesce(F.col("fold") != fold, F.lit(True)) | F.col("is_synthetic")), df.where((F.col("fold") == fold) & ~F.col("is_synthetic"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n, class_weight (n / (classes * n of the class)) and positive_weight (negatives / positives, for positives) of each class."""
    classes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = classes.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"), F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("_p"))
    out = classes.crossJoin(F.broadcast(total)).withColumn("class_weight", F.col("_n") / (F.col("_k") * F.col("n")))
    return out.withColumn("positive_weight", F.when(F.col(label) == 1, F.try_divide(F.col("_n") - F.col("_p"), F.col("_p"))).otherwise(1.0)).drop("_n", "_k", "_p")


def nearest_of(x: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, distance) of the k rows of block nearest to each row of x, and of those that rounding may bring among them;
    rows with the own id don't count. Squared distances by products pick them out, exact ones are given."""
    square = (block**2).sum(1)
    out = []
    for a in range(0, len(x), KNN_QUERIES):
        q = x[a : a + KNN_QUERIES]
        d = np.maximum((q**2).sum(1)[:, None] + square - 2 * (q @ block.T), 0)
        d[own[a : a + KNN_QUERIES, None] == ids] = np.inf
        far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * ((q**2).sum(1) + square.max())  # what the products may be off
        near = np.sqrt(d) <= (np.sqrt(far + slack) + np.sqrt(slack) + 2e-6)[:, None]
        i, j = np.nonzero(near & np.isfinite(d))
        out.append((i + a, ids[j], np.round(np.sqrt(((q[i] - block[j]) ** 2).sum(1)), 6)))
    return tuple(np.concatenate(c) for c in zip(*out))


def neighbours(points: DataFrame, id_col: str, vector: str, k: int = 5) -> DataFrame:
    """(id, rank, neighbour, dist): the k nearest other rows, the lower id first of equals. Rows are dealt into blocks of bounded
    size, each two blocks meet in one task, and the best of each row are merged. Rows without an id or a vector have no part."""
    points = points.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    blocks = max(1, -(-points.count() // KNN_BLOCK))
    dealt = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries, base = dealt.select("id", "v", F.col("block").alias("a"), every.alias("b")), dealt.select("id", "v", every.alias("a"), F.col("block").alias("b"))

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "dist": []}).astype({"id": "int64", "neighbour": "int64", "dist": "float64"})
        own = q["id"].to_numpy()
        i, neighbour, dist = nearest_of(np.array(q["v"].tolist(), float), own, np.array(b["v"].tolist(), float), b["id"].to_numpy(), k)
        order = np.lexsort((neighbour, dist, i))
        i, neighbour, dist = i[order], neighbour[order], dist[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return pd.DataFrame({"id": own[i], "neighbour": neighbour, "dist": dist})[rank < k]

    out = queries.groupBy("a", "b").cogroup(base.groupBy("a", "b")).applyInPandas(best, "id long, neighbour long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbour", "dist")


def smote(minority: DataFrame, need: int, id_col: str, vector: str, k: int = 5) -> DataFrame:
    """(synthetic, seed, neighbour, u, vector): ``need`` points between rows and one of their k neighbours. Seeds go round in the
    order of ids; which neighbour and how far is a linear congruence of the number, so results are repeatable anywhere."""
    near = neighbours(minority, id_col, vector, k)
    order = numbered(minority.select(id_col), id_col, "_i")
    total, most = order.count(), near.agg(F.max("rank")).first()[0]
    if not total or not most or need <= 0:
        return minority.sparkSession.createDataFrame([], f"synthetic long, seed long, neighbour long, u double, {vector} array<double>")
    made = minority.sparkSession.range(need).select(F.col("id").alias("synthetic"), (F.col("id") % total).alias("_i"), F.expr(f"int((id * 1103515245 + 12345) % 2147483648 % {most}) + 1").alias("rank"), (F.expr("(id * 69069 + 1) % 2147483648") / F.lit(2147483648.0)).alias("u"))
    made = made.join(order, "_i").join(near, [id_col, "rank"])
    a, b = minority.select(id_col, F.col(vector).alias("_a")), minority.select(F.col(id_col).alias("neighbour"), F.col(vector).alias("_b"))
    made = made.join(a, id_col).join(b, "neighbour")
    point = F.zip_with("_a", "_b", lambda p, q: p.cast("double") + F.col("u") * (q.cast("double") - p.cast("double")))
    return made.select("synthetic", F.col(id_col).alias("seed"), "neighbour", "u", point.alias(vector))


def oversampled(rows: DataFrame, need: int, k: int = 5) -> DataFrame:
    """rows (row_id, features, label, fold, is_synthetic) and, after them, ``need`` synthetic ones of label 1, without a fold, with
    ids that go on from the largest."""
    last = rows.agg(F.max("row_id")).first()[0] or 0
    made = smote(rows.where("label = 1").select("row_id", "features"), need, "row_id", "features", k)
    made = made.select((F.col("synthetic") + last + 1).alias("row_id"), "features", F.lit(1).alias("label"), F.lit(None).cast("int").alias("fold"), F.lit(True).alias("is_synthetic"))
    return rows.select("row_id", F.col("features").cast("array<double>").alias("features"), "label", "fold", "is_synthetic").unionByName(made)


def labelled(rows: DataFrame, label: str = "label") -> DataFrame:
    """The rows that have a label, as an integer."""
    return rows.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def aligned(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep and, in the order that a model was trained with, all its features; those that df lacks are NULL."""
    return with_missing(df, features).select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
