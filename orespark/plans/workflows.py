"""Registered queries that compose operators: what is written is read back, what is fitted is saved and loaded, what is said of scores
and attributions is checked row by row. Where SQL can't give a value it states what must hold of each row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BBOX, FOLDS, GridMeta
from ..functions import columns as C
from ..functions import crs
from ..operators import dataset, explain, grid, metrics, models
from ..session import shared_dir
from ..sources import files, geopackage, rasters, sites
from . import queries as q
from .carriers import BANDS, CELLS, MATRIX, META, POINTS, SAMPLES, cells, embedded, extent, matrix, samples, table, two_bands


def folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/orespark/{uuid.uuid4().hex}"


# Sources and sinks


@q.query(f"WITH {SAMPLES} SELECT sample_id, x, y, zn_ppm FROM samples")
def geopackage_roundtrip(spark, d):
    path = f"{folder(spark)}/assays.gpkg"
    geopackage.write_layer(samples(spark, d), path, "till_geochemistry")
    return geopackage.read_layer(spark, path, "till_geochemistry", "sample_id bigint, zn_ppm double").select("sample_id", "x", "y", "zn_ppm")


def _as_rasters(spark, d) -> str:
    """Both bands as files: a GeoTIFF and an ASCII grid."""
    to, at = folder(spark), extent(two_bands(spark, d))
    for band, end in (("tmi", "tif"), ("rad_k", "asc")):
        rasters.write_raster(two_bands(spark, d).where(F.col("band") == band), at, f"{to}/{band}_epsg2953.{end}", {"units": "nT"})
    return to


@q.query(f"""WITH {BANDS} SELECT band, "row", col, CASE band WHEN 'tmi' THEN value::FLOAT::DOUBLE ELSE value END AS value FROM bands""")
def raster_roundtrip(spark, d):
    return rasters.read_rasters(spark, _as_rasters(spark, d)).select(C.band_name("path").alias("band"), "row", "col", "value")


@q.query("SELECT * FROM (VALUES (0::BIGINT, 'rad_k_epsg2953.asc'), (1, 'tmi_epsg2953.tif')) v(pos, name)")
def raster_discovery(spark, d):
    found = files.discover(spark, _as_rasters(spark, d)).select("name").coalesce(1)
    return found.select(F.monotonically_increasing_id().alias("pos"), "name")


_IMP = "i AS (SELECT p_brand AS model, p_type AS feature, round(avg(p_retailprice), 6) AS importance FROM part GROUP BY 1, 2)"


@q.query(f"WITH {_IMP} SELECT row_number() OVER (ORDER BY importance DESC, model, feature) - 1 AS pos, model, feature, importance FROM i")
def csv_roundtrip(spark, d):
    """Sorted, as one file with a header, and read again in its order."""
    path = folder(spark)
    files.write_csv(q._importances(spark, d), path, [F.desc("importance"), "model", "feature"])
    back = files.read_csv(spark, path, "model string, feature string, importance double").coalesce(1)
    return back.select(F.monotonically_increasing_id().alias("pos"), "model", "feature", "importance")


@q.query("SELECT row_number() OVER (ORDER BY p_type) - 1 AS pos, p_type AS feature FROM (SELECT DISTINCT p_type FROM part)")
def feature_list_csv(spark, d):
    """A list of features without a header."""
    path = folder(spark)
    table(spark, d, "part").select("p_type").distinct().orderBy("p_type").coalesce(1).write.text(path)
    return spark.createDataFrame(list(enumerate(files.feature_list(spark, path))), "pos long, feature string")


@q.query("SELECT p_partkey, p_size FROM part WHERE p_size > 10")
def table_cache(spark, d):
    """Made once, found the second time, then replaced by a part of itself."""
    path = folder(spark)
    files.materialized(lambda: table(spark, d, "part").select("p_partkey", "p_size"), path, spark)
    again = files.materialized(lambda: 1 / 0, path, spark)
    files.replace_table(again.where("p_size > 10"), path)
    return spark.read.parquet(path)


_FEATURE = "SELECT event_id, event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS longitude, (event_id % 90)::DOUBLE AS latitude FROM events"


def _layer(spark, d) -> str:
    to = folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("x"), (F.col("event_id") % 90).cast("double").alias("y"))
    files.write_layer_pages(spark, e, to, "event_id", "x", "y")
    return to


@q.query(f"SELECT event_id, event_type, longitude, latitude FROM ({_FEATURE}) WHERE longitude BETWEEN 10 AND 60 AND latitude BETWEEN 20 AND 70")
def paged_layer(spark, d):
    """A layer saved page by page, read with an envelope: by Spark's JSON reader, and by a data source of its own, which must agree."""
    to, box = _layer(spark, d), (10.0, 20.0, 60.0, 70.0)
    spark.dataSource.register(files.PagedLayer)
    one = files.read_pages(spark, to, box).select(F.col("attributes")["event_id"].cast("long").alias("event_id"), F.col("attributes")["event_type"].alias("event_type"), "longitude", "latitude")
    own = spark.read.format("paged_layer").option("envelope", ",".join(map(str, box))).load(to)
    own = own.select(F.get_json_object("attributes", "$.event_id").cast("long").alias("event_id"), F.get_json_object("attributes", "$.event_type").alias("event_type"), "longitude", "latitude")
    return one.intersectAll(own)


@q.query("SELECT count(*) AS n FROM events")
def layer_count(spark, d):
    return spark.createDataFrame([(files.layer_count(spark, _layer(spark, d)),)], "n long")


@q.query("SELECT * FROM (VALUES ('tmi_epsg2953.tif', true), ('/absolute', true), ('none.tif', false)) v(source, found)")
def source_paths(spark, d):
    """A source is found by its whole path, or below the rasters' folder; else there is an error."""
    to = _as_rasters(spark, d)
    out = []
    for name, source in (("tmi_epsg2953.tif", "tmi_epsg2953.tif"), ("/absolute", f"{to}/tmi_epsg2953.tif"), ("none.tif", "none.tif")):
        try:
            out.append((name, files.resolve(spark, source, to) == f"{to}/tmi_epsg2953.tif"))
        except FileNotFoundError:
            out.append((name, False))
    return spark.createDataFrame(out, "source string, found boolean")


@q.query("SELECT p_partkey AS key, p_size AS size_cm FROM part")
def clean_names(spark, d):
    return C.clean_names(table(spark, d, "part").select(F.col("p_partkey").alias(" Key"), F.col("p_size").alias("SIZE_CM ")))


# Sites, training sets


@q.query(f"WITH {SAMPLES} SELECT 'GEOCHEM_' || (row_number() OVER (ORDER BY sample_id) - 1) AS site_id, 'till_geochem' AS source, NULL::INT AS label, x, y FROM samples")
def assay_sites(spark, d):
    return sites.assay_sites(samples(spark, d), "sample_id").select("site_id", "source", "label", "x", "y")


@q.query(f"SELECT i AS id, round({BBOX[0]}::DOUBLE + (i * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE * {BBOX[2] - BBOX[0]!r}::DOUBLE, 9) AS lon, round({BBOX[1]}::DOUBLE + (i * 69069 + 1) % 2147483648 / 2147483648.0::DOUBLE * {BBOX[3] - BBOX[1]!r}::DOUBLE, 9) AS lat, (i < 45)::INT AS label, round((i * 1664525 + 1013904223) % 2147483648 / 2147483648.0::DOUBLE, 9) AS intensity FROM range(295) t(i)")
def mock_points(spark, d):
    m = sites.mock_points(spark)
    return m.select("id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "label", F.round("intensity", 9).alias("intensity"))


@q.query("SELECT doc_id, n_chars, quality::INT AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def labelled_rows(spark, d):
    return dataset.labelled(table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left"))


@q.query("""WITH r AS (SELECT vec_id AS row_id, (label = 0)::INT AS label, (vec_id % 5)::INT AS fold, false AS is_synthetic FROM embeddings)
SELECT * FROM r UNION ALL SELECT (SELECT max(row_id) FROM r) + 1 + i, 1, NULL, true FROM range((SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) FROM r)) t(i)""")
def training_set(spark, d):
    """Real rows and, after them, as many synthetic ones as balance the classes; written and read."""
    rows = embedded(spark, d)
    need = rows.agg(F.count_if(F.col("label") == 0) - F.count_if(F.col("label") == 1)).first()[0]
    path = folder(spark)
    dataset.oversampled(rows, need).write.parquet(path)
    return spark.read.parquet(path).select("row_id", "label", "fold", "is_synthetic")


@q.query(f"WITH {MATRIX} SELECT point_id, NULL::DOUBLE AS em_conductivity, zn_ppm, k::DOUBLE AS k FROM matrix")
def aligned_features(spark, d):
    return dataset.aligned(matrix(spark, d), ["em_conductivity", "zn_ppm", "k"], ["point_id"])


# Reprojection, features of the grid

_DEGREES = GridMeta(-66.85, 47.95, 0.0165, 0.005, 100, 150)


def _sql_edge():
    part = "(SELECT k / 20.0::DOUBLE AS t FROM range(21) r(k)), g"
    sides = ("x0 + t * (x1 - x0) AS lon, y0 AS lat", "x0 + t * (x1 - x0), y1", "x0, y1 + t * (y0 - y1)", "x1, y1 + t * (y0 - y1)")
    return " UNION ALL ".join(f"SELECT 0 AS point_id, {s} FROM {part}" for s in sides)


_STEP = " ".join(
    f", p{i} AS (SELECT *, phi{i - 1} - (ln(tan(phi{i - 1} / 2 + pi() / 4) * pow((1 - {crs.E!r} * sin(phi{i - 1})) / (1 + {crs.E!r} * sin(phi{i - 1})), {crs.E / 2!r})) - psi) * cos(phi{i - 1}) * (1 - {crs.E2!r} * sin(phi{i - 1}) ** 2) / (1 - {crs.E2!r}) AS phi{i} FROM p{i - 1})"
    for i in range(1, 5)
)
_G = crs.SCALE * __import__("math").tan(__import__("math").pi / 4 - crs.CHI0 / 2)
_H = 2 * crs.SCALE * __import__("math").tan(crs.CHI0) + _G


@q.query(f"""WITH {CELLS}, g AS (SELECT -66.85::DOUBLE AS x0, 47.95::DOUBLE AS y0, -66.85::DOUBLE + (max(col) + 1) * 0.0165::DOUBLE AS x1, 47.95::DOUBLE - (max("row") + 1) * 0.005::DOUBLE AS y1 FROM cells),
lonlat AS ({_sql_edge()}), {q._FORWARD}, e AS (SELECT min(x) AS ex, max(y) AS ey, ceil((max(x) - min(x)) / 2000)::BIGINT AS w, ceil((max(y) - min(y)) / 2000)::BIGINT AS h FROM xy),
o AS (SELECT (i // w)::INT AS "row", (i % w)::INT AS col, ex + (i % w + 0.5) * 2000 - {crs.FE!r} AS e, ey - (i // w + 0.5) * 2000 - {crs.FN!r} AS n FROM (SELECT *, unnest(range(w * h)) AS i FROM e)),
ij AS (SELECT *, atan(e / ({_H!r} + n)) AS i FROM o), ji AS (SELECT *, atan(e / ({_G!r} - n)) - i AS j FROM ij),
ch AS (SELECT *, {crs.CHI0!r} + 2 * atan((n - e * tan(j / 2)) / {crs.SCALE!r}) AS chi, degrees((j + 2 * i) / {crs.N!r} + {crs.LON0!r}) AS lon FROM ji),
ps AS (SELECT *, 0.5 * ln((1 + sin(chi)) / ({crs.C!r} * (1 - sin(chi)))) / {crs.N!r} AS psi FROM ch), p0 AS (SELECT *, 2 * atan(exp(psi)) - pi() / 2 AS phi0 FROM ps){_STEP},
f AS (SELECT "row" AS tr, col AS tc, (47.95::DOUBLE - degrees(phi4)) / 0.005::DOUBLE - 0.5 AS fr, (lon - -66.85::DOUBLE) / 0.0165::DOUBLE - 0.5 AS fc FROM p4),
k AS (SELECT tr, tc, (floor(fr) + u)::INT AS "row", (floor(fc) + v)::INT AS col, CASE u WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE v WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w FROM f, (VALUES (0), (1)) s(u), (VALUES (0), (1)) z(v))
SELECT 'tmi' AS band, tr AS "row", tc AS col, round(sum(w * value) / sum(w) FILTER (value IS NOT NULL), 1) AS value FROM k JOIN cells USING ("row", col) WHERE w > 0 GROUP BY 2, 3""")
def raster_reproject(spark, d):
    """The raster, taken for one in degrees, on the grid that its densified edge gives in the target CRS."""
    c = cells(spark, d)
    at = extent(c)
    source = GridMeta(_DEGREES.x0, _DEGREES.y0, _DEGREES.dx, _DEGREES.dy, at.width, at.height)
    return grid.reproject(c, source, grid.projected_grid(spark, source, 2000.0)).withColumn("value", F.round("value", 1))


_GRID = q._MATRIX.replace(POINTS, """points AS (SELECT ("row" * 100 + col) AS point_id, (col + 0.5) * 1000.0::DOUBLE AS x, 150000 - ("row" + 0.5) * 1000.0::DOUBLE AS y FROM (SELECT unnest(range((SELECT max("row") + 1 FROM cells))) AS "row"), range(100) c(col))""").replace("floor(p.y / 10000) AS line", "p.point_id // 100 AS line")


@q.query(f"""WITH {_GRID} SELECT point_id AS cell_id, mag_tmi, rad_k, zn_ppm, {q.R.format('sqrt(g * g + 1e-12 + 1e-6)')} AS mag_hgm, CASE WHEN zn_ppm IS NOT NULL THEN {q.R.format('log10(greatest(zn_ppm, 1e-6))')} END AS log_zn_ppm, {q.R.format('coalesce((zn_ppm - a) / (d + 1e-6), 0) / 6')} AS geochem_meas FROM g, x""")
def grid_features(spark, d):
    """The features that grid_scoring scores, of every cell."""
    g = q.grid_features_at(spark, d).select("cell_id", "mag_tmi", "rad_k", "zn_ppm", "mag_hgm", "log_zn_ppm", "geochem_meas")
    return q.rounded(g, "mag_hgm", "log_zn_ppm", "geochem_meas")


@q.query(f"""WITH {CELLS} SELECT i AS cell_id, true AS scored, true AS written, 'rf' AS model FROM range((SELECT (max("row") + 1) * (max(col) + 1) FROM cells)) t(i)""")
def grid_scoring_raster(spark, d):
    """Every cell scored by a model that was saved and loaded, written as a raster with tags, and read back."""
    at, path = extent(two_bands(spark, d)), f"{folder(spark)}/prospectivity.tif"
    scores = q.stored(spark, q.grid_scoring(spark, d).select("cell_id", "score"))
    placed = scores.select(F.expr(f"int(cell_id div {at.width})").alias("row"), F.expr(f"int(cell_id % {at.width})").alias("col"), F.col("score").alias("value"))
    rasters.write_raster(placed, at, path, {"model": "rf", "units": "probability", "resolution": str(at.dx)})
    tags = rasters.read_tags(spark, path)
    back = rasters.read_rasters(spark, path.rpartition("/")[0]).select((F.col("row") * at.width + F.col("col")).cast("long").alias("cell_id"), "value")
    same = F.col("value") == F.col("score").cast("float").cast("double")
    return scores.join(back, "cell_id").select("cell_id", F.col("score").between(0, 1).alias("scored"), same.alias("written"), F.lit(tags["model"]).alias("model"))


# Models and attributions


@q.query(f"WITH {POINTS} SELECT model, point_id, true AS same FROM points, (VALUES ('rf'), ('gbt')) m(model)")
def model_roundtrip(spark, d):
    """Forest and boosted trees, with their features' order and medians: the loaded ones score as the fitted ones."""
    rows = q.stored(spark, q.feature_matrix(spark, d)).withColumn("label", (F.col("point_id") % 7 == 0).cast("int"))
    out = None
    for kind, params in (("rf", {"numTrees": 8, "maxDepth": 4}), ("gbt", {"maxIter": 3, "maxDepth": 3})):
        made, path = models.train(rows, q.TRAINED, kind, **params), folder(spark)
        made.save(path)
        a, b = (m.score(rows, ["point_id"]).withColumnRenamed("score", s) for m, s in ((made, "a"), (models.load(spark, path), "b")))
        one = a.join(b, "point_id").select(F.lit(kind).alias("model"), "point_id", ((F.col("a") == F.col("b")) & F.col("a").between(0, 1)).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


_REAL = "SELECT vec_id AS row_id, (label = 0)::INT AS label, (vec_id % 5)::INT AS fold FROM embeddings"


def _each_once(spark, d, kind, **params) -> DataFrame:
    scores = models.out_of_fold(dataset.oversampled(embedded(spark, d), 50), kind, FOLDS, **params)
    return scores.select("model", "fold", "row_id", "label", F.col("score").between(0, 1).alias("scored"))


@q.query(f"SELECT 'rf' AS model, fold, row_id, label, true AS scored FROM ({_REAL})")
def forest_scores_each_row(spark, d):
    """Out of fold, with synthetic rows in every training set: each real row once, in its own fold."""
    return _each_once(spark, d, "rf", numTrees=5, maxDepth=4)


@q.query(f"SELECT 'gbt' AS model, fold, row_id, label, true AS scored FROM ({_REAL})")
def boosted_scores_each_row(spark, d):
    return _each_once(spark, d, "gbt", maxIter=3, maxDepth=3)


@q.query("SELECT model, 64::BIGINT AS features, 1.0::DOUBLE AS total, true AS descending FROM (VALUES ('rf'), ('gbt')) m(model)")
def importances_add_up(spark, d):
    """Refitted on all rows: an importance for each feature, 1 in all, sorted for export."""
    out = None
    for kind, params in (("rf", {"numTrees": 5, "maxDepth": 4}), ("gbt", {"maxIter": 3, "maxDepth": 3})):
        path = folder(spark)
        files.write_csv(models.importances(models.fit(embedded(spark, d), kind, **params), q._NAMES, kind), path, [F.desc("importance"), "feature"])
        back = files.read_csv(spark, path, "model string, feature string, importance double").coalesce(1).withColumn("pos", F.monotonically_increasing_id())
        before = F.lag("importance").over(Window.partitionBy("model").orderBy("pos"))
        one = back.withColumn("ok", F.coalesce(before >= F.col("importance"), F.lit(True))).groupBy("model").agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.bool_and("ok").alias("descending"))
        out = one if out is None else out.unionByName(one)
    return out


def _shap_and_scores(spark, d):
    data = embedded(spark, d)
    model = models.fit(data, "rf", numTrees=6, maxDepth=4)
    return data, model, explain.shap_values(model, data, q._NAMES, shared_dir(spark))


@q.query("SELECT vec_id AS row_id, true AS adds_up, true AS sums FROM embeddings")
def shap_additivity(spark, d):
    """Each row's values and the expected value add up to the model's score, and shap_sum is the values' sum."""
    data, model, shap = _shap_and_scores(spark, d)
    both = shap.join(models.score(model, data, ["row_id"]), "row_id")
    total = sum((F.col(f"shap_{n}") for n in q._NAMES[1:]), F.col(f"shap_{q._NAMES[0]}"))
    return both.select("row_id", (F.abs(F.col("shap_sum") + F.col("expected") - F.col("score")) < 1e-9).alias("adds_up"), (F.abs(total - F.col("shap_sum")) < 1e-9).alias("sums"))


@q.query("SELECT vec_id AS row_id, true AS same FROM embeddings")
def shap_export(spark, d):
    """The attribution matrix as CSV, read back."""
    _, _, shap = _shap_and_scores(spark, d)
    path = folder(spark)
    files.write_csv(shap, path, ["row_id"])
    back = files.read_csv(spark, path, shap.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    return shap.select("row_id", F.col("shap_sum").alias("a")).join(back.select("row_id", F.col("shap_sum").alias("b")), "row_id").select("row_id", (F.abs(F.col("a") - F.col("b")) < 1e-12).alias("same"))


@q.query("SELECT i AS rank, true AS by_size, true AS in_summary, (i <= 4)::BOOLEAN AS in_dependence FROM range(1, 16) t(i)")
def shap_views(spark, d):
    """The ranking against means over the long form, which the summary and dependence views are cut from."""
    data, _, shap = _shap_and_scores(spark, d)
    shap = spark.createDataFrame(shap.toArrow())
    long = explain.long_form(shap, data, q._NAMES)
    means = {r.feature: r.m for r in long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("m")).collect()}
    ranked = [(r.feature, r.mean_abs_shap) for r in explain.ranking(shap, q._NAMES, 15).collect()]
    best = sorted(means.items(), key=lambda x: (-x[1], x[0]))
    rows = data.count()
    count = {r.feature: r["count"] for r in long.groupBy("feature").count().collect()}
    top = {f for f, _ in ranked[:4]}
    seen = {r.feature for r in long.where(F.col("feature").isin([f for f, _ in explain.ranking(shap, q._NAMES, 4).collect()])).select("feature").distinct().collect()}
    out = [(i, abs(m - best[i - 1][1]) < 1e-9 and abs(means[f] - m) < 1e-9, count[f] == rows, f in top and f in seen) for i, (f, m) in enumerate(ranked, 1)]
    return spark.createDataFrame(out, "rank long, by_size boolean, in_summary boolean, in_dependence boolean")


@q.query(f"WITH {q._FOLD} SELECT model, printf('AUC %.4f +/- %.4f, AP %.4f', roc_auc_mean, roc_auc_std, avg_prec_mean) AS line FROM sm")
def metric_report(spark, d):
    return q._summary(spark, d).select("model", F.format_string("AUC %.4f +/- %.4f, AP %.4f", "roc_auc_mean", "roc_auc_std", "avg_prec_mean").alias("line"))
