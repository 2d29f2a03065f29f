"""Operators that must not gather a group, against numpy."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orespark.config import GridMeta
from orespark.functions import columns as C
from orespark.operators import dataset, grid, models, spatial
from orespark.operators.quantiles import quantiles
from orespark.plans import queries as plans
from orespark.sources import files, geopackage, rasters


def test_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"even": rng.random(9000), "skewed": np.concatenate((rng.lognormal(0, 6, 9000), [1e18])), "ties": rng.integers(0, 3, 9000).astype(float), "one": np.array([7.0]), None: rng.normal(size=5000)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("ties", None), ("even", float("nan"))]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.02, 0.5, 0.98]).collect()}
    for g, vs in groups.items():
        assert np.allclose([got[g].q0, got[g].q1, got[g].q2], np.quantile(vs, [0.02, 0.5, 0.98]), rtol=1e-12), g
    assert got["none"].q1 is None and quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).isEmpty()
    assert quantiles(spark.createDataFrame([(1.0,), (2.0,)], "v double"), [], "v", [0.5]).first().q0 == 1.5


def test_neighbours_need_little_memory():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(20_000, 16)), 1)
    x[100:110] = x[100]
    tracemalloc.start()
    i, found, dist = dataset.nearest_of(x[:700], np.arange(700), x, np.arange(20_000), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    for a in range(0, 700, 37):
        d = np.round(np.sqrt(((x - x[a]) ** 2).sum(1)), 6)
        d[a] = np.inf
        want = np.lexsort((np.arange(20_000), d))[:5]
        mine = [(q, int(n)) for q, n in zip(dist[i == a], found[i == a])]
        assert [n for _, n in sorted(mine)[:5]] == want.tolist()


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dataset, "KNN_BLOCK", 40)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, size=(150, 3)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, [0.0] * 3), (900, None)], "id long, v array<double>")
    got = {}
    for r in dataset.neighbours(df, "id", "v", 4).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbour, r.dist)
    for k in range(150):
        d = np.round(np.sqrt(((x - x[k]) ** 2).sum(1)), 6)
        d[k] = np.inf
        want = np.lexsort((np.arange(150), d))[:4]
        assert [got[k][n][0] for n in (1, 2, 3, 4)] == want.tolist()


def test_numbers(spark):
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(-(10**6), 10**6, 3000))
    df = spark.createDataFrame([(int(k),) for k in rng.permutation(keys)], "k long")
    assert {r.k: r.n for r in dataset.numbered(df, "k", "n").collect()} == {int(k): i for i, k in enumerate(keys)}
    assert dataset.numbered(df.where("false"), "k", "n").isEmpty()


def test_large_rasters_by_tiles(spark, tmp_path):
    rng = np.random.default_rng(9)
    meta, held = GridMeta(0.0, 600.0, 1.0, 1.0, 530, 600), rng.integers(0, 600 * 530, 4000)
    cells = spark.createDataFrame([(int(k) // 530, int(k) % 530, float(k)) for k in np.unique(held)], "row int, col int, value double")
    for name in ("a.tif", "a.asc"):
        rasters.write_raster(cells, meta, str(tmp_path / name / name), {"units": "x"})
        back = rasters.read_rasters(spark, str(tmp_path / name))
        assert back.count() == 600 * 530 and back.where("value is not null").select("row", "col", "value").exceptAll(cells).isEmpty()
        assert back.where("value is not null").count() == cells.count()
    got, whole, tags = rasters.read_tiff((tmp_path / "a.tif" / "a.tif").read_bytes())
    assert (got.width, got.height, got.y0, tags) == (530, 600, 600.0, {"units": "x"}) and np.nansum(whole) == cells.agg(F.sum("value")).first()[0]


def test_a_raster_passes_the_driver_in_parts(spark, tmp_path, monkeypatch):
    """Of a raster that is written, some tiles at once; of one that is read, no bytes at all, for its tags neither."""
    passed, frame = [], type(spark.range(1))
    whole, some = frame.collect, frame.toLocalIterator

    def collect(self):
        rows = whole(self)
        passed.extend(("whole", len(v)) for r in rows for v in r if isinstance(v, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(frame, "collect", collect)
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a: passed.append(("parts", self.rdd.getNumPartitions())) or some(self, *a))
    monkeypatch.setattr(rasters, "PASSED_BYTES", 300_000, raising=False)
    meta = GridMeta(0.0, 1000.0, 1.0, 1.0, 1000, 1000)
    cells = spark.range(1000 * 1000).selectExpr("int(id div 1000) AS row", "int(id % 1000) AS col", "hash(id) / 1e9 AS value")
    rasters.write_raster(cells, meta, path := str(tmp_path / "a" / "a.tif"), {"model": "rf"})
    size = (tmp_path / "a" / "a.tif").stat().st_size
    assert rasters.read_tags(spark, path) == {"model": "rf"} and size > 3_000_000
    tiles = size - len(rasters.tiff_head(meta, [0] * 16, {"model": "rf"}, 2953, True))
    assert passed == [("parts", 1 + tiles // 300_000)]
    back = rasters.read_rasters(spark, str(tmp_path / "a"))
    assert back.join(cells.withColumnRenamed("value", "v"), ["row", "col"]).where("value = double(float(v))").count() == 1000 * 1000


def test_many_points_are_many_files(spark, tmp_path):
    pts = spark.range(50).selectExpr("double(id) AS x", "if(id = 3, NULL, double(-id)) AS y", "concat('n', id) AS name")
    geopackage.write_layer(pts, str(tmp_path / "l"), "sites", rows=20)
    back = geopackage.read_layer(spark, str(tmp_path / "l"), "sites", "name string")
    assert len(list((tmp_path / "l").glob("*.gpkg"))) == 3 and back.count() == 50 and back.where("x is null").count() == 1


def test_a_replacement_that_stopped(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(f"{path}.old")  # moved aside, and then the run stopped
    files.replace_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()


def test_folds_of_one_class_are_told(spark):
    rows = [(i, [float(i), 1.0], int(i < 2), int(i >= 2), False) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int, fold int, is_synthetic boolean")
    with pytest.warns(UserWarning, match="one class"):
        got = models.out_of_fold(df, "rf", 3, numTrees=2).collect()
    assert sorted(r.row_id for r in got) == list(range(12)) and all(r.score is None for r in got)


def test_names_and_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        C.clean_names(spark.createDataFrame([(1, 2)], "`A ` int, a int"))
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, "x.tif", str(tmp_path))


def test_the_edge_of_a_grid_is_followed(spark):
    source = GridMeta(-67.0, 48.0, 0.05, 0.05, 40, 20)
    loose, fine = grid.projected_grid(spark, source, 100.0, 1), grid.projected_grid(spark, source, 100.0, 50)
    assert fine.height > loose.height  # the sides bend outwards


def most_rows(plan) -> int:
    """Rows out of the operator of an executed plan that gives most."""
    name, found = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    below = plan.children()
    return max([found.get().value() if found.isDefined() else 0, *map(most_rows, inner), *(most_rows(below.apply(i)) for i in range(below.size()))])


def nearest(left, right, radius):
    out = {}
    for p, x, y in left:
        met = [(float(np.hypot(x - sx, y - sy)), s) for s, sx, sy in right if None not in (x, y, sx, sy)]
        out[p] = min([m for m in met if m[0] <= radius], default=(None, None))
    return out


def test_nearest_of_uneven_sites(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_PLACES", 3)
    rng = np.random.default_rng(10)
    place = lambda n: [*np.round(rng.uniform(-3000, 3000, (n, 2)), 1).tolist(), *np.round(rng.normal(700, 20, (n, 2)), 3).tolist(), *np.round(rng.integers(-3, 3, (n, 2)) * 250.0, 1).tolist()]
    left = [(i, *xy) for i, xy in enumerate([*place(60), (None, 0.0), (0.0, float("nan")), (float("inf"), 0.0), (-0.0, 0.0), (9e6, 9e6)])]
    right = [(1000 - i, *xy) for i, xy in enumerate([*place(50), (None, 1.0), (float("nan"), 0.0), (0.0, -float("inf"))])]
    a, b = spark.createDataFrame(left, "p int, x double, y double"), spark.createDataFrame(right, "s int, x double, y double")
    for radius in (50.0, 1000.0, 9000.0):
        got = {r.p: (r.dist, r.s) for r in spatial.nearest_join(a, b, radius=radius, left_id="p", right_id="s").collect()}
        want = nearest(left, right, radius)
        assert got.keys() == want.keys()
        for p, (dist, s) in want.items():
            assert got[p][1] == s and (dist is None or abs(got[p][0] - dist) < 1e-9), (radius, p)
    assert spatial.nearest_join(a, b.where("false"), radius=50.0, left_id="p", right_id="s").where("s is null and dist is null").count() == len(left)


@pytest.mark.parametrize("places", [1, 1500])
def test_nearest_does_not_meet_all_pairs(spark, places):
    """All within the radius of each other, whether at one place or at many."""
    at = lambda name, k: spark.range(1500).selectExpr(f"id AS {name}", f"double(id % {places} * {k} % 1511) AS x", f"double(id % {places} * {k + 20} % 1499) AS y")
    df = spatial.nearest_join(at("p", 37), at("s", 101), radius=10000.0, left_id="p", right_id="s")
    rows = df.collect()
    assert len(rows) == 1500 and all(r.s is not None for r in rows)
    assert most_rows(df._jdf.queryExecution().executedPlan()) < 1500 * 100


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """The smallest tables, parts and suppliers 60 times with keys that put the copies at the same places."""
    to, db = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    for name, key, copies in (("part", "p_partkey", 60), ("supplier", "s_suppkey", 60), ("orders", "o_orderkey", 1)):
        db.execute(f"COPY (SELECT * REPLACE ({key} + 10007 * i AS {key}) FROM '/root/testdata/sf0.001/{name}.parquet', range({copies}) r(i)) TO '{to}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{to}/{name}.parquet'")
    return str(to), db


def test_the_matrix_of_crowded_places(spark, crowded):
    d, db = crowded
    df = plans.QUERIES["feature_matrix_full"](spark, d)
    got, names = df.collect(), ", ".join(df.columns)
    want = db.execute(f"SELECT {names} FROM ({plans.ORACLES['feature_matrix_full']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(got) == 12_000
    assert most_rows(df._jdf.queryExecution().executedPlan()) < 60_000


def test_points_are_sampled_row_by_row(spark):
    """Points that share an id, or have none, or lie outside the grid, each have the values of their own cell."""
    cells = spark.range(60 * 60).selectExpr("int(id div 60) AS row", "int(id % 60) AS col", "double(id) AS v").selectExpr("row", "col", "inline(array(struct('a' AS band, v AS value), struct('b' AS band, if(row = 50, null, -v) AS value), struct('c' AS band, 0D AS value)))")
    at = [(1, 10.5, 49.5), (1, 11.5, 48.5), (None, 12.5, 9.5), (2, -5.0, 10.0), (3, None, 1.0), (4, 10.5, 49.5)]
    got = grid.sample_wide(spark.createDataFrame(at, "id int, x double, y double"), cells, GridMeta(0.0, 60.0, 1.0, 1.0, 60, 60), ["a", "b"])
    assert got.columns == ["id", "x", "y", "a", "b"]
    want = [(1, 10.5, 49.5, 610.0, -610.0), (1, 11.5, 48.5, 671.0, -671.0), (None, 12.5, 9.5, 3012.0, None), (2, -5.0, 10.0, None, None), (3, None, 1.0, None, None), (4, 10.5, 49.5, 610.0, -610.0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert grid.sample_wide(got.select("id", "x", "y").where("false"), cells, GridMeta(0.0, 60.0, 1.0, 1.0, 60, 60), ["a"]).count() == 0
