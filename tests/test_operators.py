"""Operators against numpy and against properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orespark.config import GridMeta
from orespark.functions import columns as C
from orespark.functions import crs
from orespark.operators import dataset, explain, features, metrics, models, potential, spatial
from orespark.sources import files, geopackage, rasters


def cells(spark, grid):
    rows = [("b", r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "band string, row int, col int, value double")


def as_grid(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        if r[name] is not None:
            out[r.row, r.col] = r[name]
    return out


def test_gradient_of_plane(spark):
    y, x = np.mgrid[0:8, 0:10] * 50.0
    g = potential.horizontal_gradient(cells(spark, 2 * x + 3 * y), 50.0)
    assert np.allclose(as_grid(g, "gx", (8, 10)), 2) and np.allclose(as_grid(g, "gy", (8, 10)), 3)


def test_vertical_derivatives(spark):
    n, k = 32, 2 * np.pi * 3 / (32 * 50.0)
    wave = np.cos(k * np.arange(n) * 50.0)[None, :].repeat(n, 0)
    d = potential.vertical_derivatives(cells(spark, wave), n, n, 50.0, {"fvd": 1, "svd": 2})
    assert np.allclose(as_grid(d, "fvd", (n, n)), k * wave, atol=1e-12) and np.allclose(as_grid(d, "svd", (n, n)), k * k * wave, atol=1e-12)
    rng = np.random.default_rng(0)
    field = rng.normal(size=(70, 90))
    field[5, 7] = np.nan
    filled = np.zeros((128, 128))
    filled[:70, :90] = np.where(np.isnan(field), np.nanmean(field), field)
    f = np.fft.fftfreq(128, 50.0) * 2 * np.pi
    want = np.fft.ifft2(np.fft.fft2(filled) * np.hypot(f[:, None], f[None, :])).real[:70, :90]
    got = as_grid(potential.vertical_derivatives(cells(spark, field), 70, 90, 50.0, {"fvd": 1}), "fvd", (70, 90))
    assert np.isnan(got[5, 7]) and np.allclose(got[~np.isnan(field)], want[~np.isnan(field)])


def test_projection(spark):
    p = spark.createDataFrame([(-66.5, 46.5), (-65.3, 47.7)], "lon double, lat double")
    xy = spatial.project(p)
    lon, lat = crs.to_lonlat("x", "y")
    rows = xy.select("x", "y", "lon", "lat", lon.alias("a"), lat.alias("b")).collect()
    assert abs(rows[0].x - 2500000) < 1e-6 and abs(rows[0].y - 7500000) < 1e-6
    assert all(abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9 for r in rows)


def test_nearest(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, 9000.0, 0.0), (4, None, 1.0)], "p int, x double, y double")
    right = spark.createDataFrame([(7, 0.0, 1000.0), (8, 0.0, -1000.0), (9, 5000.0, 1000.1), (5, 9000.0, 0.0)], "s int, x double, y double")
    got = {r.p: r.s for r in spatial.nearest_join(left, right, left_id="p", right_id="s").collect()}
    assert got == {1: 7, 2: None, 3: 5, 4: None}


def test_scalars(spark):
    a = spark.createDataFrame([(None,), (0.0,), (1e-9,), (1.0,), (100.0,)], "v double").select(F.round(C.log10_clip("v"), 9).alias("l")).collect()
    assert [r.l for r in a] == [None, -6, -6, 0, 2]
    df = spark.createDataFrame([(None if i < 100 else 1.0, None if i < 50 else 1.0, None if i < 51 else 1.0) for i in range(100)], "a double, b double, c double")
    assert features.keep_columns(df, ["a", "b", "c", "d"]) == ["b"]
    x = spark.createDataFrame([(float(i),) for i in range(11)], "x double").select(C.strip("x", F.lit(0.0), F.lit(10.0), 5).alias("f")).collect()
    assert [r.f for r in x] == [min(4, np.digitize(i, np.linspace(0, 10, 6)) - 1) for i in range(11)]


def test_metrics(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s)], "model string, label int, score double")
    auc = np.mean([(p > q) + (p == q) / 2 for p in s[y == 1] for q in s[y == 0]])
    assert metrics.roc_auc(df, ["model"]).first().auc == pytest.approx(auc)
    assert metrics.roc_auc(df.withColumn("score", 1 - F.col("score")), ["model"]).first().auc == pytest.approx(1 - auc)
    one = df.where("label = 1")
    assert metrics.roc_auc(one, ["model"]).first().auc is None and metrics.roc_auc(df.where("false"), ["model"]).isEmpty()


def test_smote_lies_between(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(8)], "id long, v array<double>")
    x = {r.id: np.array(r.v) for r in df.collect()}
    rows = dataset.smote(df, 30, "id", "v").collect()
    assert len(rows) == 30
    for r in rows:
        assert np.allclose(np.array(r.v), x[r.seed] + r.u * (x[r.neighbour] - x[r.seed]))


def test_shapley_adds_up(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(r[0] + r[1] * r[2] > 0), 0, False) for i, r in enumerate(x)], "row_id long, features array<double>, label int, fold int, is_synthetic boolean")
    model = models.fit(df, "rf", numTrees=4, maxDepth=4)
    shap = explain.shap_values(model, df, list("abcd"), str(tmp_path))
    both = shap.join(models.score(model, df, ["row_id"]), "row_id").collect()
    assert len(both) == 80 and all(abs(r.shap_sum + r.expected - r.score) < 1e-6 for r in both)


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(300, 270)).astype(np.float32).astype(float)
    grid[0, 0] = np.nan
    meta = GridMeta(2473432.0, 7662007.0, 50.0, 50.0, 270, 300)
    got, back, tags = rasters.read_tiff(rasters.write_tiff(meta, grid, {"units": "nT"}))
    assert np.allclose(back, grid, equal_nan=True) and tags == {"units": "nT"} and (got.x0, got.y0, got.dx, got.width) == (meta.x0, meta.y0, 50.0, 270)
    _, back = rasters.parse_ascii(rasters.format_ascii(meta, grid))
    assert np.allclose(back, grid, equal_nan=True)
    small = cells(spark, grid[:5, :6])
    rasters.write_raster(small, GridMeta(0, 5, 1, 1, 6, 5), str(tmp_path / "r" / "a.tif"))
    rasters.write_raster(small, GridMeta(0, 5, 1, 1, 6, 5), str(tmp_path / "r" / "b.asc"))
    read = rasters.read_rasters(spark, str(tmp_path / "r"))
    assert read.count() == 60 and read.where("value IS NULL").count() == 2


def test_files(spark, tmp_path):
    pts = spark.createDataFrame([(1.5, 2.5, "a", 1), (3.0, 4.0, None, 2)], "x double, y double, name string, n int")
    geopackage.write_layer(pts, str(tmp_path / "a.gpkg"), "sites")
    assert sorted(geopackage.read_layer(spark, str(tmp_path / "a.gpkg"), "sites", "name string, n int").collect(), key=lambda r: r.n) == pts.collect()
    (tmp_path / "layer").mkdir()
    (tmp_path / "layer" / "count.json").write_text('{"count": 1002}')
    (tmp_path / "layer" / "page-00000.json").write_text('{"features": [{"attributes": {"ZN": 3}, "geometry": {"x": 1.0, "y": 2.0}}]}')
    (tmp_path / "layer" / "page-00001.json").write_text('{"features": [{"attributes": {"ZN": 4}, "geometry": null}]}')
    spark.dataSource.register(files.PagedLayer)
    assert spark.read.format("paged_layer").load(str(tmp_path / "layer")).count() == 2
    path = str(tmp_path / "t")
    files.materialized(lambda: pts, path, spark)
    files.replace_table(files.materialized(lambda: 1 / 0, path, spark).where("n = 1"), path)
    assert spark.read.parquet(path).count() == 1


def test_stream(spark, tmp_path):
    from orespark.streaming.ingest import run_available, windowed_means

    e = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 03:00:00", "a", 3.0), ("2024-01-05 00:00:00", "a", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    run_available(windowed_means(spark, str(tmp_path / "in"), "ts timestamp_ntz, event_type string, value double"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 2.0)]
