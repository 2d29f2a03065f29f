"""Tree ensembles over rows (row_id, features: array, label, fold, is_synthetic): fitting, search, scoring."""

from __future__ import annotations

import math
import random
import warnings
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from threading import Lock

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SEED
from ..session import relieve_driver
from . import forests
from .dataset import aligned, impute, medians, split
from .metrics import fold_metrics, summary

#: Spaces that are searched (fixed values): name -> (kind, low, high) or a list of choices.
FOREST_SPACE = {"numTrees": ("int", 100, 800), "maxDepth": ("int", 3, 30), "minInstancesPerNode": ("int", 1, 20), "featureSubsetStrategy": ["sqrt", "log2", "0.3", "0.5"]}
BOOSTED_SPACE = {"maxIter": ("int", 100, 1000), "maxDepth": ("int", 3, 10), "stepSize": ("log", 0.01, 0.3), "subsamplingRate": ("float", 0.5, 1.0), "featureSubsetStrategy": ["0.5", "0.6", "0.7", "0.8", "0.9", "all"], "minInstancesPerNode": ("int", 1, 20), "minInfoGain": ("float", 0.0, 5.0)}


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col("label").cast("double"))


def weighted(df: DataFrame, kind: str) -> DataFrame:
    """df with the weight of each row: balanced classes for the forest, negatives / positives for boosted positives."""
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return df.withColumn("_w", F.lit(1.0))
    if kind == "rf":
        return df.withColumn("_w", F.when(F.col("label") == 1, (pos + neg) / (2 * pos)).otherwise((pos + neg) / (2 * neg)))
    return df.withColumn("_w", F.when(F.col("label") == 1, neg / pos).otherwise(1.0))


def fit(df: DataFrame, kind: str, **params):
    cls = RandomForestClassifier if kind == "rf" else GBTClassifier
    params = {"cacheNodeIds": params.get("numTrees", 0) >= 100} | params  # else each level sends all trees to its tasks anew; the model is the same
    return cls(featuresCol="_x", labelCol="_y", weightCol="_w", seed=SEED, **params).fit(weighted(vectors(df), kind))


def score(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and score, the probability of label 1."""
    return model.transform(vectors(df.withColumn("label", F.col("label") if "label" in df.columns else F.lit(None).cast("int")))).select(*keep, vector_to_array("probability")[1].alias("score"))


def out_of_fold(df: DataFrame | forests.Gathered, kind: str, folds: int, **params) -> DataFrame:
    """model, fold, row_id, label, score of every real row, by the model that has not seen its fold; the score is NULL, and a warning
    says so, where the other folds have one class only. The folds are fitted side by side."""
    if isinstance(df, forests.Gathered):
        return df.out_of_fold(**params)
    sizes = {(r.fold, r.label, r.is_synthetic): r["count"] for r in df.groupBy("fold", "label", "is_synthetic").count().collect()}

    def scored(k):
        train, test = split(df, k)
        if not any(f == k and not made for f, _, made in sizes):
            return None
        if len({label for f, label, made in sizes if f != k or made}) < 2:
            warnings.warn(f"fold {k} is not scored: the others have one class only", stacklevel=3)
            return test.select("fold", "row_id", "label", F.lit(None).cast("double").alias("score"))
        return score(fit(train, kind, **params), test, ["fold", "row_id", "label"])

    with ThreadPoolExecutor(max(1, folds)) as pool:
        parts = [p for p in pool.map(scored, range(folds)) if p is not None]
    out = df.sparkSession.createDataFrame([], "fold int, row_id long, label int, score double")
    for p in parts:
        out = out.unionByName(p)
    return out.withColumn("model", F.lit(kind))


def importances(model, names: list[str], kind: str) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame([(kind, n, float(v)) for n, v in zip(names, values)], "model string, feature string, importance double")


def _draw(rng: random.Random, spec):
    if isinstance(spec, list):
        return rng.choice(spec)
    kind, lo, hi = spec
    if kind == "int":
        return rng.randint(lo, hi)
    return math.exp(rng.uniform(math.log(lo), math.log(hi))) if kind == "log" else rng.uniform(lo, hi)


def _near(rng: random.Random, spec, good: list, bad: list, draws: int = 24):
    """The draw around good trials for which good ones are densest against bad ones (a tree of Parzen estimators)."""
    if isinstance(spec, list):
        weight = {c: (1 + good.count(c)) / (len(good) + len(spec)) / ((1 + bad.count(c)) / (len(bad) + len(spec))) for c in spec}
        return max(sorted(spec, key=str), key=lambda c: weight[c] * (0.9 + 0.2 * rng.random()))
    kind, lo, hi = spec
    to = math.log if kind == "log" else float
    a, b = to(lo), to(hi)
    g, d = [to(x) for x in good], [to(x) for x in bad]

    def density(x, points):
        width = max((b - a) / (1 + len(points)) ** 0.5, 1e-9)
        return (sum(math.exp(-0.5 * ((x - p) / width) ** 2) for p in points) / width + 1 / (b - a)) / (len(points) + 1)

    tries = [min(b, max(a, rng.gauss(rng.choice(g), (b - a) / (1 + len(g)) ** 0.5))) for _ in range(draws)]
    x = max(tries, key=lambda t: density(t, g) / density(t, d))
    return round(x) if kind == "int" else math.exp(x) if kind == "log" else x


def search(df: DataFrame, kind: str, folds: int, trials: int, space: dict | None = None, start: int = 10, at_once: int = 5) -> DataFrame:
    """trial, params, roc_auc_mean: random trials first, then around the best quarter of those before. Each trial is a
    cross-validation of its own; ``at_once`` of them are drawn from the same history and run side by side. Forests over a table that
    a task can hold are grown some trees a task (forests.py), others by Spark's."""
    space = space or (FOREST_SPACE if kind == "rf" else BOOSTED_SPACE)
    rng, done = random.Random(SEED), []
    rows = (forests.gathered(df, folds, space) if kind == "rf" else None) or df
    turn = nullcontext() if rows is df else Lock()  # many queries planned at once fill the driver's heap with garbage

    def tried(params):
        scored = out_of_fold(rows, kind, folds, **params)
        with turn:
            row = summary(fold_metrics(scored)).first()
            relieve_driver(df.sparkSession)
        return params, float(row.roc_auc_mean) if row and row.roc_auc_mean is not None else 0.0

    def drawn():
        if len(done) < start:
            return {k: _draw(rng, s) for k, s in space.items()}
        ranked = sorted(done, key=lambda x: -x[1])
        cut = max(1, len(ranked) // 4)
        return {k: _near(rng, s, [p[k] for p, _ in ranked[:cut]], [p[k] for p, _ in ranked[cut:]]) for k, s in space.items()}

    with ThreadPoolExecutor(at_once) as pool:
        while len(done) < trials:
            done += pool.map(tried, [drawn() for _ in range(min(at_once, trials - len(done)))])
    return df.sparkSession.createDataFrame([(i, str(dict(sorted(p.items()))), v) for i, (p, v) in enumerate(done)], "trial int, params string, roc_auc_mean double")


@dataclass
class Bundle:
    """A model, the features that it was trained with, in their order, and what fills each where it is missing."""

    kind: str
    model: object
    features: list[str]
    medians: DataFrame

    def prepared(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and features, as the model takes them: all of them, in order, the missing ones filled."""
        whole = impute(aligned(df, self.features, keep), self.features, self.medians)
        return whole.select(*keep, F.array(*self.features).alias("features"))

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return score(self.model, self.prepared(df, keep), keep)

    def save(self, folder: str) -> None:
        self.model.write().overwrite().save(f"{folder}/model")
        spark = self.medians.sparkSession
        row = self.medians.first()
        rows = [(i, c, float(row[c]) if row[c] is not None else None, self.kind) for i, c in enumerate(self.features)]
        spark.createDataFrame(rows, "pos int, feature string, median double, kind string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/transforms")


def load(spark, folder: str) -> Bundle:
    """A saved bundle."""
    rows = sorted(spark.read.parquet(f"{folder}/transforms").collect())
    kind, names = rows[0].kind, [r.feature for r in rows]
    cls = RandomForestClassificationModel if kind == "rf" else GBTClassificationModel
    filled = spark.createDataFrame([tuple(r.median for r in rows)], ", ".join(f"`{c}` double" for c in names))
    return Bundle(kind, cls.load(f"{folder}/model"), names, filled)


def train(rows: DataFrame, features: list[str], kind: str, **params) -> Bundle:
    """Fit on labelled rows (features, label); missing features are filled by their medians, those without any value by 0."""
    whole = aligned(rows, features, ["label"])
    found = medians(whole, features).fillna(0.0)
    bundle = Bundle(kind, None, features, found)
    bundle.model = fit(bundle.prepared(whole, ["label"]), kind, **params)
    return bundle
