"""The feature matrix: engineered columns, missing values, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ASSAYS, EPS_TABLE, MAX_NULL_FRACTION
from ..functions.columns import analytic_signal_1d, available, gradient_magnitude, log10_clip, ratio, with_missing
from .potential import gradient


def zscore_anomaly(df: DataFrame, columns: list[str], name: str = "geochem_meas", eps: float = EPS_TABLE) -> DataFrame:
    """df with the mean z-score of the columns that it has (sample deviation; a missing value scores 0)."""
    have, _ = available(df, columns)
    if not have:
        return df.withColumn(name, F.lit(None).cast("double"))
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in have for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    scores = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + eps), F.lit(0.0)) for c in have]
    total = reduce(lambda a, b: a + b, scores)
    return df.crossJoin(F.broadcast(stats)).select(*df.columns, (total / len(have)).alias(name))


def engineer(df: DataFrame, *, series: list[str], order: str, tmi: str = "mag_tmi", fvd: str = "mag_rmi_fvd_bmc") -> DataFrame:
    """The matrix with all engineered columns; the same for training and scoring. Gradients run along ``order`` in each series."""
    df = with_missing(df, [tmi, fvd, "rad_k", "rad_th", "rad_u", *ASSAYS])
    df = df.withColumn("_t", F.coalesce(tmi, F.lit(0.0))).withColumn("_f", F.coalesce(fvd, F.lit(EPS_TABLE))).withColumn("_g", gradient("_t", series, order))
    df = df.withColumn("mag_hgm", gradient_magnitude("_g", "_f")).withColumn("mag_as", analytic_signal_1d("_g", "_f")).drop("_t", "_f", "_g")
    df = df.withColumns({"rad_k_th": ratio("rad_k", "rad_th"), "rad_u_th": ratio("rad_u", "rad_th"), "rad_th_k": ratio("rad_th", "rad_k"), **{f"log_{c}": log10_clip(c) for c in ASSAYS}})
    return zscore_anomaly(df, ASSAYS)


def null_report(df: DataFrame, columns: list[str], top: int = 20, warn: float = 0.3) -> DataFrame:
    """column, n_null, null_fraction, warn: the columns with most NULLs, counted in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("r")).select("r.*", F.try_divide(F.col("r.n_null"), F.col("_n")).alias("null_fraction"))
    return long.withColumn("warn", F.col("null_fraction") > warn).orderBy(F.desc("n_null"), "column").limit(top)


def keep_columns(df: DataFrame, columns: list[str], most: float = MAX_NULL_FRACTION) -> list[str]:
    """The columns whose part of NULLs is at most this."""
    have, _ = available(df, columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in have]).first()
    return [c for c in have if row[c] is not None and row[c] <= most]
