"""Engine inputs made from the fixture tables, and the same as SQL for the oracle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GridMeta

#: Where the raster that ``orders`` stands for lies: 100 columns of 1 km cells. Its height is that of the smaller tables; extent()
#: has the real one.
META = GridMeta(0.0, 150000.0, 1000.0, 1000.0, 100, 150)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr("'tmi' AS band", "int(o_orderkey div 100) AS row", "int(o_orderkey % 100) AS col", "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value")


CELLS = """cells AS (SELECT 'tmi' AS band, (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders)"""


def extent(cells: DataFrame) -> GridMeta:
    """META as wide and high as the cells reach."""
    last = cells.agg(F.max("row"), F.max("col")).first()
    return replace(META, height=0 if last[0] is None else last[0] + 1, width=0 if last[1] is None else last[1] + 1)


def two_bands(spark, d) -> DataFrame:
    return cells(spark, d).unionByName(table(spark, d, "orders").selectExpr("'rad_k' AS band", "int(o_orderkey div 100) AS row", "int(o_orderkey % 100) AS col", "CAST(o_custkey AS DOUBLE) AS value"))


BANDS = CELLS + """, bands AS (SELECT * FROM cells UNION ALL SELECT 'rad_k', (o_orderkey // 100)::INT, (o_orderkey % 100)::INT, o_custkey::DOUBLE FROM orders)"""


def points(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS point_id", "CAST(p_partkey * 7919 % 10007 * 10 AS DOUBLE) AS x", "CAST(p_partkey * 104729 % 10007 * 10 AS DOUBLE) AS y")


POINTS = "points AS (SELECT p_partkey AS point_id, (p_partkey * 7919 % 10007 * 10)::DOUBLE AS x, (p_partkey * 104729 % 10007 * 10)::DOUBLE AS y FROM part)"


def samples(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_suppkey AS sample_id", "CAST(s_suppkey * 6133 % 10007 * 10 AS DOUBLE) AS x", "CAST(s_suppkey * 15485863 % 10007 * 10 AS DOUBLE) AS y", "s_acctbal AS zn_ppm")


SAMPLES = "samples AS (SELECT s_suppkey AS sample_id, (s_suppkey * 6133 % 10007 * 10)::DOUBLE AS x, (s_suppkey * 15485863 % 10007 * 10)::DOUBLE AS y, s_acctbal AS zn_ppm FROM supplier)"


def lonlat(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey AS point_id", "CAST(-66.85 AS DOUBLE) + (c_custkey % 50) * CAST(0.033 AS DOUBLE) AS lon", "CAST(47.10 AS DOUBLE) + (c_custkey % 17) * CAST(0.05 AS DOUBLE) AS lat")


LONLAT = "lonlat AS (SELECT c_custkey AS point_id, -66.85::DOUBLE + (c_custkey % 50) * 0.033::DOUBLE AS lon, 47.10::DOUBLE + (c_custkey % 17) * 0.05::DOUBLE AS lat FROM customer)"


def matrix(spark, d) -> DataFrame:
    """A feature matrix with gaps: one row for each part."""
    return table(spark, d, "part").selectExpr("p_partkey AS point_id", "p_size AS k", "CASE WHEN p_size > 5 THEN p_retailprice END AS zn_ppm", "CASE WHEN p_size > 35 THEN p_retailprice / 10 END AS pb_ppm", "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS cu_ppm", "CAST(p_size AS DOUBLE) / 50 AS ag_ppm")


MATRIX = "matrix AS (SELECT p_partkey AS point_id, p_size AS k, CASE WHEN p_size > 5 THEN p_retailprice END AS zn_ppm, CASE WHEN p_size > 35 THEN p_retailprice / 10 END AS pb_ppm, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS cu_ppm, p_size::DOUBLE / 50 AS ag_ppm FROM part)"


def scored(spark, d) -> DataFrame:
    """Two models' scores of labelled documents, with ties, in five folds."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    both = F.explode(F.array(F.struct(F.lit("rf").alias("model"), F.expr("(n_chars % 997 * 100 div 997) / 100D").alias("score")), F.struct(F.lit("xgb").alias("model"), F.expr("((n_chars % 89 + 30 * quality) * 100 div 120) / 100D").alias("score"))))
    return rows.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.expr("int(doc_id % 5)").alias("fold"), both.alias("m")).select("row_id", "label", "fold", "m.*")


SCORED = """scored AS (SELECT doc_id AS row_id, quality AS label, (doc_id % 5)::INT AS fold, model, CASE model WHEN 'rf' THEN (n_chars % 997 * 100 // 997) / 100.0::DOUBLE ELSE ((n_chars % 89 + 30 * quality) * 100 // 120) / 100.0::DOUBLE END AS score
FROM labels JOIN documents USING (doc_id), (VALUES ('rf'), ('xgb')) m(model))"""


def embedded(spark, d) -> DataFrame:
    """Feature vectors: label 0 is the positive class, in five folds."""
    return table(spark, d, "embeddings").selectExpr("vec_id AS row_id", "embedding AS features", "CAST(label = 0 AS INT) AS label", "int(vec_id % 5) AS fold", "false AS is_synthetic")
