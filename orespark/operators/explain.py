"""Shapley values of a random forest's probability of label 1, with the training rows' shares as the background (the
path-dependent kind).

A leaf's value is shared out among the features on its path. For each of them the weighted sum over subsets of the others is a
polynomial in their size, made up factor by factor; rows are handled all at once for a leaf.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest_nodes(model, folder: str) -> list[list[tuple]]:
    """(id, value, cover, left, right, feature, threshold) of each tree's nodes, read from the model as it is saved."""
    from pyspark.sql import SparkSession

    path = f"{folder}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    rows = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, list[tuple]] = {}
    for r in rows:
        stats = list(r.impurityStats)
        cover = float(sum(stats))
        cut = list(r.split.leftCategoriesOrThreshold)
        trees.setdefault(r.treeID, []).append((r.id, stats[1] / cover if cover else 0.0, cover, r.leftChild, r.rightChild, r.split.featureIndex, cut[0] if cut else 0.0))
    return [sorted(trees[t]) for t in sorted(trees)]


def leaves(tree: list[tuple]) -> list[tuple[float, dict]]:
    """(value, {feature: (low, high, share)}) of each leaf: low < x <= high leads there, and share is the product of the parts of
    rows that went its way at the feature's splits."""
    node = {n[0]: n for n in tree}
    out, stack = [], [(tree[0][0], {})]
    while stack:
        i, path = stack.pop()
        _, value, cover, left, right, feature, cut = node[i]
        if left < 0:
            out.append((value, path))
            continue
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
            part = node[child][2] / cover if cover else 0.0
            stack.append((child, path | {feature: (*bounds, share * part)}))
    return out


def expected(trees: list[list[tuple]]) -> float:
    return float(np.mean([sum(v * math.prod(s for _, _, s in p.values()) for v, p in leaves(t)) for t in trees]))


def shapley(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Values of each feature for each row of x; with the expected value they add up to the prediction."""
    phi = np.zeros(x.shape)
    for tree in trees:
        for value, path in leaves(tree):
            if not path:
                continue
            features = list(path)
            d = len(features)
            one = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in features], axis=1).astype(float)
            zero = np.array([path[f][2] for f in features])
            weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
            for i, f in enumerate(features):
                sums = np.zeros((len(x), d))
                sums[:, 0] = 1.0
                for j in range(d):
                    if j != i:  # each other feature is in the subset (its row's own way) or not (the share of rows)
                        moved = sums[:, :-1] * one[:, j : j + 1]
                        sums *= zero[j]
                        sums[:, 1:] += moved
                phi[:, f] += value * (one[:, i] - zero[i]) * (sums @ weight)
    return phi / max(1, len(trees))


def shap_values(model, df: DataFrame, names: list[str], folder: str, id_col: str = "row_id", features: str = "features") -> DataFrame:
    """id, shap_<feature> of each, shap_sum, expected for each row. The node table is the model itself, whose size is set by its
    parameters."""
    trees = forest_nodes(model, folder)
    sent, base = df.sparkSession.sparkContext.broadcast(trees), expected(trees)
    columns = [f"shap_{n}" for n in names]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                phi = shapley(sent.value, np.array(pdf[features].tolist(), float))
                yield pd.DataFrame({id_col: pdf[id_col]} | {c: phi[:, k] for k, c in enumerate(columns)} | {"shap_sum": phi.sum(1), "expected": base})

    schema = f"{id_col} long, " + ", ".join(f"`{c}` double" for c in columns) + ", shap_sum double, expected double"
    return df.select(id_col, features).mapInPandas(run, schema)


def ranking(shap: DataFrame, names: list[str], top: int = 15) -> DataFrame:
    """feature, mean_abs_shap: the largest first."""
    one = shap.agg(*[F.avg(F.abs(f"shap_{n}")).alias(n) for n in names])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean_abs_shap")) for n in names])).alias("r")).select("r.*")
    return long.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)


def long_form(shap: DataFrame, df: DataFrame, names: list[str], id_col: str = "row_id", features: str = "features") -> DataFrame:
    """id, feature, value, shap: what a summary or a dependence plot shows."""
    both = shap.join(df.select(id_col, features), id_col)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(features)[k].cast("double").alias("value"), F.col(f"shap_{n}").alias("shap")) for k, n in enumerate(names)])
    return both.select(id_col, F.explode(rows).alias("r")).select(id_col, "r.*")
