"""Queries against their oracles on the smallest tables, and all others for columns and rows."""

import os

import duckdb
import pytest

import __spark_entry__
from orespark.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
SOME = ["zscore_anomaly", "crs_forward", "nearest_join_1km", "distance_label_rule", "raster_sample_wide", "raster_warp_bilinear", "gradient_2d", "all_derivatives", "spatial_grid_folds", "smote_synthesize", "roc_curve", "pr_auc_trapezoid", "fold_metric_summary", "literal_points_union",
        "geopackage_roundtrip", "raster_roundtrip", "paged_layer", "table_cache", "training_set", "raster_reproject", "grid_features", "grid_scoring_raster", "model_roundtrip", "forest_scores_each_row", "shap_additivity", "shap_views"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, db, name):
    got = plans.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({plans.ORACLES[name]})").fetchall()

    def plain(rows):
        return sorted([tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows], key=str)

    a, b = plain(map(tuple, got.select(columns).collect())), plain(want)
    assert a == b


def test_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(plans.QUERIES) >= 100
