"""Queries that do the whole job, whatever the size of their input."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from orespark.plans import queries as plans

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MORE), reason="no test data")


def raster(d):
    t = pq.read_table(f"{d}/orders.parquet", columns=["o_orderkey", "o_orderstatus", "o_totalprice"]).to_pydict()
    grid = np.full((max(t["o_orderkey"]) // 100 + 1, 100), np.nan)
    for k, s, v in zip(*t.values()):
        if s != "P":
            grid[k // 100, k % 100] = v
    return grid


def got(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df:
        if r[name] is not None:
            out[r.row, r.col] = r[name]
    return out


def vertical(grid, order):
    n, m = (1 << (x - 1).bit_length() for x in grid.shape)
    filled = np.zeros((n, m))
    filled[: grid.shape[0], : grid.shape[1]] = np.where(np.isnan(grid), np.nanmean(grid), grid)
    k = 2 * np.pi * np.hypot(np.fft.fftfreq(n, 50.0)[:, None], np.fft.fftfreq(m, 50.0)[None])
    return np.fft.ifft2(np.fft.fft2(filled) * k**order).real[: grid.shape[0], : grid.shape[1]]


def total(grid):
    gy, gx = np.gradient(np.nan_to_num(grid), 50.0)
    return np.sqrt(gx * gx + gy * gy + 1e-10)


def test_derivatives_of_the_whole_raster(spark):
    grid = raster(MORE)
    has = ~np.isnan(grid)
    assert grid.shape == (150, 100)
    rows = plans.QUERIES["vertical_derivatives_fft"](spark, MORE).collect()
    assert len(rows) == grid.size
    fvd, svd = vertical(grid, 1), vertical(grid, 2)
    for name, want in (("fvd", fvd), ("svd", svd)):
        g = got(rows, name, grid.shape)
        assert np.array_equal(~np.isnan(g), has) and np.allclose(g[has], want[has], atol=1e-3)
    rows = plans.QUERIES["all_derivatives"](spark, MORE).collect()
    assert len(rows) == has.sum()
    thg = total(grid)
    tdr = np.where(has, np.arctan2(fvd, thg + 1e-10), np.nan)
    for name, want in (("thg", thg), ("as", np.sqrt(thg**2 + fvd**2 + 1e-10)), ("tdr", tdr), ("thdr", total(tdr))):
        assert np.allclose(got(rows, name, grid.shape)[has], want[has], atol=1e-3 if name == "as" else 1e-4), name


def test_every_row_is_scored(spark):
    scores = plans.QUERIES["gbt_scores"](spark, SMALL).select("row_id", "fold").collect()
    assert sorted(r.row_id for r in scores) == sorted(pq.read_table(f"{SMALL}/embeddings.parquet")["vec_id"].to_pylist())
    assert {r.fold for r in scores} == set(range(5))


def test_the_search_has_its_whole_budget(spark, monkeypatch):
    from types import SimpleNamespace

    from orespark.config import FOLDS, TRIALS

    seen = []

    def fake(df, kind, folds, **params):
        seen.append((folds, params))
        return params["numTrees"]

    monkeypatch.setattr(plans.models, "out_of_fold", fake)
    monkeypatch.setattr(plans.models, "fold_metrics", lambda scored: scored)
    monkeypatch.setattr(plans.models, "summary", lambda trees: SimpleNamespace(first=lambda: SimpleNamespace(roc_auc_mean=trees / 800)))
    assert plans.QUERIES["hpo_trials"](spark, SMALL).count() == TRIALS == len(seen)
    for folds, params in seen:
        assert folds == FOLDS and params.keys() == plans.models.FOREST_SPACE.keys()
        assert 100 <= params["numTrees"] <= 800 and 3 <= params["maxDepth"] <= 30 and 1 <= params["minInstancesPerNode"] <= 20
    assert max(p["maxDepth"] for _, p in seen) > 4


def test_the_whole_raster_is_warped_and_scored(spark):
    grid = raster("/root/testdata/sf0.1")
    across, down = 67, -(-grid.shape[0] * 1000 // 1300)
    want = {}
    for i in range(across * down):
        fr, fc = (150000 - (149600 - i // across * 1300)) / 1000 - 0.5, (300 + i % across * 1500) / 1000 - 0.5
        r, c = int(np.floor(fr)), int(np.floor(fc))
        four = [(r + a, c + b, (fr - r if a else 1 - (fr - r)) * (fc - c if b else 1 - (fc - c))) for a in (0, 1) for b in (0, 1)]
        four = [(grid[p, q], w) for p, q, w in four if w > 1e-9 and 0 <= p < grid.shape[0] and 0 <= q < grid.shape[1]]
        if four:
            seen = [(v, w) for v, w in four if not np.isnan(v)]
            want[i] = sum(v * w for v, w in seen) / sum(w for _, w in seen) if seen else None
    rows = {r.cell_id: r.value for r in plans.QUERIES["raster_warp_bilinear"](spark, "/root/testdata/sf0.1").collect()}
    assert rows.keys() == want.keys()
    for k, v in want.items():
        assert (rows[k] is None) == (v is None) and (v is None or abs(rows[k] - v) < 1e-3), k
    scored = plans.QUERIES["grid_scoring"](spark, "/root/testdata/sf0.1").select("cell_id", "score").collect()
    assert sorted(r.cell_id for r in scored) == list(range(grid.size)) and all(r.score is not None for r in scored)


@pytest.mark.parametrize("name", ["model_roundtrip", "grid_scoring"])
def test_models_read_the_matrix_from_a_file(spark, monkeypatch, name):
    """Medians, fitting and scoring read it many times; its joins run once."""
    seen, train = [], plans.models.train
    monkeypatch.setattr(plans.models, "train", lambda rows, *a, **k: seen.append(rows) or train(rows, *a, **k))
    assert not plans.QUERIES[name](spark, SMALL).isEmpty()
    assert seen and all("Join" not in r._jdf.queryExecution().executedPlan().toString() for r in seen)


def test_scores_become_a_raster_without_the_driver(spark, monkeypatch):
    """Neither the scores nor the decoded raster pass the driver."""
    def refused(*a):
        raise AssertionError("on the driver")

    monkeypatch.setattr(type(spark.range(1)), "toArrow", refused)
    monkeypatch.setattr("orespark.sources.rasters.read_tiff", refused)
    rows = plans.QUERIES["grid_scoring_raster"](spark, SMALL).collect()
    assert len(rows) == raster(SMALL).size and all(r.scored and r.written and r.model == "rf" for r in rows)


def test_trees_are_not_sent_anew(spark):
    rows, params = plans.embedded(spark, SMALL), {"numTrees": 100, "maxDepth": 3}
    made, plain = plans.models.fit(rows, "rf", **params), plans.models.fit(rows, "rf", cacheNodeIds=False, **params)
    assert made.getCacheNodeIds() and made.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
