"""Curves and scores of classifiers, over rows (model, fold, label, score) grouped by any columns.

Curves run over the different scores of a group. Their running sums are made in two steps, so that no task gets a whole group:
within ranges of scores, and over the ranges, whose number is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

#: Ranges of scores between 0 and 1.
RANGES = 1024


def running_counts(scored: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by, score, pos, neg (rows with the score), tp, fp (rows with at least it), p, n (rows of the group). Scores stand in [0, 1]
    for the ranges to be even; others are right all the same."""
    each = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    each = each.withColumn("range", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * RANGES))
    above = Window.partitionBy(*by).orderBy(F.desc("range"))
    whole = Window.partitionBy(*by)
    ranges = each.groupBy(*by, "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    ranges = ranges.select(*by, "range", (F.sum("rp").over(above) - F.col("rp")).alias("tp0"), (F.sum("rn").over(above) - F.col("rn")).alias("fp0"), F.sum("rp").over(whole).alias("p"), F.sum("rn").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("score"))
    out = each.join(ranges, [*by, "range"])
    return out.withColumn("tp", F.col("tp0") + F.sum("pos").over(inside)).withColumn("fp", F.col("fp0") + F.sum("neg").over(inside)).drop("range", "tp0", "fp0")


def roc_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, fpr, tpr: NULL where the group lacks a class."""
    return running_counts(scored, by).select(*by, F.col("score").alias("threshold"), F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, auc, by ranks in which equal scores share the middle one; NULL where the group lacks a class."""
    c = running_counts(scored, by)
    won = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2.0))
    return c.groupBy(*by).agg(F.try_divide(won, F.max("p") * F.max("n")).alias("auc"))


def pr_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, recall, precision, prevalence."""
    return running_counts(scored, by).select(*by, F.col("score").alias("threshold"), F.try_divide("tp", "p").alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("p") / (F.col("p") + F.col("n"))).alias("prevalence"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, ap: precision summed over the steps of recall."""
    return running_counts(scored, by).groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("p")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def pr_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, pr_auc: the trapezoids under the curve that begins at recall 0, precision 1. A range's first point needs the last one of
    the range above, whose counts are its own less the rows with its score."""
    c = running_counts(scored, by)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(F.try_divide(tp0, tp0 + fp0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("p")) * (before + here) / 2).alias("pr_auc"))


def confusion(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    said, true = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(*by).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def balanced_accuracy(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """by, balanced_accuracy: the mean recall of the classes that the group has."""
    c = confusion(scored, by, threshold)
    a, b = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return c.select(*by, F.coalesce((a + b) / 2, a, b).alias("balanced_accuracy"))


def precision_at(scored: DataFrame, by: list[str], k: int, id_col: str) -> DataFrame:
    """by, precision_at_k: the part of positives among the k highest scores, the lower id first of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), id_col)
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.avg((F.col("label") == 1).cast("double")).alias("precision_at_k"))


def fold_metrics(scored: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """model, fold, roc_auc, avg_prec, balanced_acc."""
    by = [model, fold]
    return roc_auc(scored, by).withColumnRenamed("auc", "roc_auc").join(average_precision(scored, by).withColumnRenamed("ap", "avg_prec"), by).join(balanced_accuracy(scored, by).withColumnRenamed("balanced_accuracy", "balanced_acc"), by)


def summary(per_fold: DataFrame, model: str = "model") -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    metrics = ["roc_auc", "avg_prec", "balanced_acc"]
    return per_fold.groupBy(model).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def winners(summaries: DataFrame, first: str, second: str, model: str = "model") -> DataFrame:
    """metric, both models' means, winner: the first only if it is better, so ties go to the second."""
    means = ["roc_auc_mean", "avg_prec_mean", "balanced_acc_mean"]
    one = summaries.agg(*[F.max(F.when(F.col(model) == m, F.col(c))).alias(f"{m}|{c}") for m in (first, second) for c in means])
    rows = F.array(*[F.struct(F.lit(c.removesuffix("_mean")).alias("metric"), F.col(f"{first}|{c}").alias("a"), F.col(f"{second}|{c}").alias("b")) for c in means])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("winner", F.when(F.col("a") > F.col("b"), first).otherwise(second))


def best_model(summaries: DataFrame, prefer: str, model: str = "model") -> DataFrame:
    """model, roc_auc_mean of the best; a tie goes to ``prefer``."""
    return summaries.orderBy(F.desc("roc_auc_mean"), F.desc(F.col(model) == prefer), model).limit(1).select(model, "roc_auc_mean")


def top_features(importances: DataFrame, k: int, by: str = "model", value: str = "importance", name: str = "feature") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(value), name)
    return importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def map_summary(cells: DataFrame, value: str = "prob") -> DataFrame:
    """One row: count, min, max, median, mean, and how many cells and percent lie over 0.5, 0.7 and 0.9."""
    over = [f for t in (0.5, 0.7, 0.9) for f in (F.count_if(F.col(value) > t).alias(f"over_{int(t * 100)}"), (100 * F.try_divide(F.count_if(F.col(value) > t), F.count(value))).alias(f"percent_{int(t * 100)}"))]
    median = quantiles(cells, [], value, [0.5]).select(F.col("q0").alias("median"))
    one = cells.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), *over)
    return one.crossJoin(F.broadcast(median))


def prevalence(label: str | Column = "label") -> Column:
    return F.avg((F.col(label) == 1).cast("double"))
