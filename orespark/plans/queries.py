"""The registered queries of the engine's own operators, each with its oracle where SQL can express it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BBOX, ENVELOPE, FOLDS, TRIALS
from ..functions import columns as C
from ..functions import crs
from ..operators import dataset, explain, features, grid, metrics, models, potential, spatial
from ..session import relieve_driver, shared_dir
from ..sources import files, sites
from .carriers import BANDS, CELLS, LONLAT, MATRIX, META, POINTS, SAMPLES, SCORED, cells, embedded, extent, lonlat, matrix, points, samples, scored, table, two_bands

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c):
    """Rounded, without a negative zero."""
    return F.round(C.col(c), 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


R = "round({0}, 6) + 0.0"

# Projections, filters, scalar functions


@query("SELECT p_partkey, p_size, p_retailprice, NULL::DOUBLE AS rad_k, 'rad_k' AS missing FROM part")
def proj_available_cols(spark, d):
    want = ["p_partkey", "p_size", "p_retailprice", "rad_k"]
    have, lack = C.available(table(spark, d, "part"), want)
    return C.with_missing(table(spark, d, "part").select(*have), want).withColumn("missing", F.lit(",".join(lack)))


@query(f"WITH {LONLAT} SELECT * FROM lonlat WHERE lon BETWEEN -66.5 AND -65.5 AND lat BETWEEN 47.2 AND 47.6")
def bbox_filter(spark, d):
    return lonlat(spark, d).where(spatial.in_bbox("lon", "lat", (-66.5, 47.2, -65.5, 47.6)))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS value, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal ELSE -9999 END AS stored FROM supplier")
def nodata_mask(spark, d):
    raw = table(spark, d, "supplier").withColumn("raw", F.when(F.col("s_suppkey") % 7 == 0, F.lit(-9999.0)).otherwise(F.col("s_acctbal")))
    return raw.select("s_suppkey", C.nodata_to_null("raw").alias("value")).withColumn("stored", C.null_to_nodata("value"))


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, {R.format('l_discount / greatest(l_tax, 1e-6)')} AS rad_k_th, {R.format('l_quantity / greatest(l_tax, 1e-6)')} AS rad_u_th, {R.format('l_tax / greatest(l_discount, 1e-6)')} AS rad_th_k FROM lineitem""")
def ratio_eps_floor(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", r6(C.ratio("l_discount", "l_tax")).alias("rad_k_th"), r6(C.ratio("l_quantity", "l_tax")).alias("rad_u_th"), r6(C.ratio("l_tax", "l_discount")).alias("rad_th_k"))


@query(f"WITH {MATRIX} SELECT point_id, " + ", ".join(f"{R.format(f'log10(greatest({c}, 1e-6))')} AS log_{c}" .replace("greatest(" + c + ", 1e-6)", f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, 1e-6) END") for c in ("zn_ppm", "pb_ppm", "cu_ppm", "ag_ppm")) + " FROM matrix")
def log10_clip(spark, d):
    return matrix(spark, d).select("point_id", *[r6(C.log10_clip(c)).alias(f"log_{c}") for c in ("zn_ppm", "pb_ppm", "cu_ppm", "ag_ppm")])


_Z = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(_Z)) + ") SELECT l_orderkey, l_linenumber, round((" .replace(") SELECT", " FROM lineitem) SELECT") + " + ".join(f"coalesce(({c} - m{i}) / (s{i} + 1e-6), 0)" for i, c in enumerate(_Z)) + ") / 4, 6) + 0.0 AS geochem_meas FROM lineitem, s")
def zscore_anomaly(spark, d):
    return rounded(features.zscore_anomaly(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_Z), _Z), "geochem_meas").select("l_orderkey", "l_linenumber", "geochem_meas")


@query(f"WITH {MATRIX} SELECT p.point_id, 'POINT (' || x::INT || ' ' || y::INT || ')' AS wkt, x, y FROM points p JOIN matrix USING (point_id)".replace("WITH ", f"WITH {POINTS}, "))
def wkt_roundtrip(spark, d):
    p = points(spark, d).withColumn("wkt", C.wkt_point(F.col("x").cast("int"), F.col("y").cast("int")))
    return p.select("point_id", "wkt", C.wkt_x("wkt").alias("x"), C.wkt_y("wkt").alias("y"))


@query("""SELECT path, CASE stem WHEN 'rad_k_nb_compiled' THEN 'rad_k' WHEN 'mag_tmi_nb_2013' THEN 'mag_tmi' ELSE stem END AS band FROM (SELECT path, regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.[A-Za-z]+$', ''), '_epsg2953$', '') AS stem
FROM (SELECT '/data/rasters/' || CASE o_orderkey % 3 WHEN 0 THEN 'rad_k_nb_compiled' WHEN 1 THEN 'mag_tmi_nb_2013' ELSE 'em_' || (o_orderkey % 11) END || '_epsg2953.tif' AS path FROM orders))""")
def band_names(spark, d):
    p = F.expr("concat('/data/rasters/', CASE o_orderkey % 3 WHEN 0 THEN 'rad_k_nb_compiled' WHEN 1 THEN 'mag_tmi_nb_2013' ELSE concat('em_', o_orderkey % 11) END, '_epsg2953.tif')")
    return table(spark, d, "orders").select(p.alias("path")).select("path", C.band_name("path").alias("band"))


# Reports and aggregates


@query(f"""WITH {MATRIX}, c AS ({' UNION ALL '.join(f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n FROM matrix" for c in ('zn_ppm', 'pb_ppm', 'cu_ppm', 'ag_ppm'))})
SELECT "column", n_null, round(n_null / n::DOUBLE, 6) + 0.0 AS null_fraction, n_null / n::DOUBLE > 0.3 AS warn FROM c ORDER BY n_null DESC, 1 LIMIT 20""".replace("AS column,", 'AS "column",'))
def null_fraction_report(spark, d):
    return rounded(features.null_report(matrix(spark, d), ["zn_ppm", "pb_ppm", "cu_ppm", "ag_ppm"]), "null_fraction")


@query(f"WITH {MATRIX} SELECT point_id, zn_ppm, ag_ppm FROM matrix")
def null_filter_features(spark, d):
    m = matrix(spark, d)
    return m.select("point_id", *features.keep_columns(m, ["zn_ppm", "pb_ppm", "cu_ppm", "ag_ppm", "au_ppb"]))


@query("SELECT l.quality AS label, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_distribution(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, round(count(*) FILTER (quality = 0) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE, 6) + 0.0 AS neg_over_pos, round(avg((quality = 1)::INT), 6) + 0.0 AS prevalence FROM labels")
def class_ratio(spark, d):
    p, n = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return table(spark, d, "labels").agg(p.alias("n_pos"), n.alias("n_neg"), r6(F.try_divide(n, p)).alias("neg_over_pos"), r6(metrics.prevalence("quality")).alias("prevalence"))


@query("""WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k, sum(n) FILTER (label = 1) AS p FROM c)
SELECT label, n, round(t / (k * n)::DOUBLE, 6) + 0.0 AS class_weight, CASE WHEN label = 1 THEN round((t - p) / p::DOUBLE, 6) + 0.0 ELSE 1.0::DOUBLE END AS positive_weight FROM c, t""")
def class_weights(spark, d):
    return rounded(dataset.balanced_weights(table(spark, d, "labels").select(F.col("quality").alias("label"))), "class_weight", "positive_weight")


@query(f"WITH {MATRIX}, m AS (SELECT median(zn_ppm) AS a, median(pb_ppm) AS b, median(cu_ppm) AS c FROM matrix) SELECT point_id, {R.format('coalesce(zn_ppm, a)')} AS zn_ppm, {R.format('coalesce(pb_ppm, b)')} AS pb_ppm, {R.format('coalesce(cu_ppm, c)')} AS cu_ppm FROM matrix, m")
def median_impute(spark, d):
    m, c = matrix(spark, d), ["zn_ppm", "pb_ppm", "cu_ppm"]
    return rounded(dataset.impute(m, c, dataset.medians(m, c)).select("point_id", *c), *c)


@query("WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(p_size) AS n, stddev_pop(p_size) AS t FROM part) SELECT p_partkey, round((p_retailprice - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS p_retailprice, round((p_size - n) / CASE WHEN t = 0 THEN 1 ELSE t END, 6) + 0.0 AS p_size FROM part, s")
def standard_scale(spark, d):
    return rounded(dataset.scale(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]), "p_retailprice", "p_size")


# Ordered series

_G = "CASE WHEN b IS NULL AND f IS NULL THEN 0 WHEN b IS NULL THEN f - value WHEN f IS NULL THEN value - b ELSE (f - b) / 2 END"
_SERIES = f"""s AS (SELECT event_id, user_id, value, lag(value) OVER w AS b, lead(value) OVER w AS f FROM (SELECT *, (epoch_us(ts) * 1000000 + event_id) AS o FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT event_id, value, {_G} AS g FROM s)""".replace(", (epoch_us(ts) * 1000000 + event_id) AS o", "")


def _series(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return e.select("event_id", "value", potential.gradient("value", ["user_id"], "o").alias("g"))


@query(f"WITH {_SERIES} SELECT event_id, round(g, 6) + 0.0 AS gradient FROM g")
def gradient_1d_series(spark, d):
    return _series(spark, d).select("event_id", r6("g").alias("gradient"))


@query(f"WITH {_SERIES} SELECT event_id, round(sqrt(g * g + value * value + 1e-6), 6) + 0.0 AS mag_hgm FROM g")
def hgm_1d(spark, d):
    return _series(spark, d).select("event_id", r6(C.gradient_magnitude("g", "value")).alias("mag_hgm"))


@query(f"WITH {_SERIES} SELECT event_id, round(sqrt(2 * g * g + value * value + 1e-6), 6) + 0.0 AS mag_as FROM g")
def analytic_signal_1d(spark, d):
    return _series(spark, d).select("event_id", r6(C.analytic_signal_1d("g", "value")).alias("mag_as"))


# Coordinates

_FORWARD = f"""a AS (SELECT *, sin(radians(lat)) AS s, {crs.N!r} * (radians(lon) - {crs.LON0!r}) AS dl FROM lonlat),
b AS (SELECT *, {crs.C!r} * pow((1 + s) / (1 - s) * pow((1 - {crs.E!r} * s) / (1 + {crs.E!r} * s), {crs.E!r}), {crs.N!r}) AS w FROM a),
c AS (SELECT *, (w - 1) / (w + 1) AS sc, sqrt(1 - pow((w - 1) / (w + 1), 2)) AS cc FROM b),
xy AS (SELECT point_id, lon, lat, {crs.FE!r} + {crs.SCALE!r} * cc * sin(dl) / (1 + sc * sin({crs.CHI0!r}) + cc * cos({crs.CHI0!r}) * cos(dl)) AS x, {crs.FN!r} + {crs.SCALE!r} * (sc * cos({crs.CHI0!r}) - cc * sin({crs.CHI0!r}) * cos(dl)) / (1 + sc * sin({crs.CHI0!r}) + cc * cos({crs.CHI0!r}) * cos(dl)) AS y FROM c)"""
_LONLAT = LONLAT.replace("::DOUBLE", "::DOUBLE")


@query(f"WITH {_LONLAT}, {_FORWARD} SELECT point_id, round(x, 3) AS x, round(y, 3) AS y FROM xy")
def crs_forward(spark, d):
    return spatial.project(lonlat(spark, d)).select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {_LONLAT} SELECT point_id, round(lon, 7) + 0.0 AS lon, round(lat, 7) + 0.0 AS lat FROM lonlat")
def crs_inverse(spark, d):
    p = spatial.project(lonlat(spark, d))
    lon, lat = crs.to_lonlat("x", "y")
    return p.select("point_id", (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


@query(f"WITH lonlat AS (SELECT 0 AS point_id, lon, lat FROM (VALUES ({BBOX[0]}::DOUBLE), ({BBOX[2]}::DOUBLE)) a(lon), (VALUES ({BBOX[1]}::DOUBLE), ({BBOX[3]}::DOUBLE)) b(lat)), {_FORWARD} SELECT round(min(x), 3) AS x_min, round(min(y), 3) AS y_min, round(max(x), 3) AS x_max, round(max(y), 3) AS y_max FROM xy")
def bbox_bounds_projected(spark, d):
    corners = spark.createDataFrame([(x, y) for x in BBOX[::2] for y in BBOX[1::2]], "lon double, lat double")
    return spatial.bounds(spatial.project(corners)).select(*[F.round(c, 3).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


def _values(rows, names):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") v({names})"


_TRAVERSE = "SELECT 'BH-' || lpad(i::VARCHAR, 3, '0') AS hole, -66.85::DOUBLE + (i % 50) * 0.032::DOUBLE AS lon, 47.12::DOUBLE + (i // 50) * 0.20::DOUBLE AS lat, (200 + (i % 7) * 50)::INT AS depth_m FROM range(51, 251) t(i)"


@query(_TRAVERSE.replace(" AS lon", " AS lon").replace("-66.85::DOUBLE + (i % 50) * 0.032::DOUBLE AS lon", "round(-66.85::DOUBLE + (i % 50) * 0.032::DOUBLE, 6) AS lon").replace("47.12::DOUBLE + (i // 50) * 0.20::DOUBLE AS lat", "round(47.12::DOUBLE + (i // 50) * 0.20::DOUBLE, 6) AS lat"))
def barren_traverse_generator(spark, d):
    return sites.traverse(spark).select("hole", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "depth_m")


@query(f"""WITH a AS (SELECT 'VMS_' || (row_number() OVER () - 1) AS site_id, 'vms_deposit' AS source, lon, lat, 1 AS label FROM {_values([r[1:3] for r in sites.DEPOSITS], 'lon, lat')}),
b AS (SELECT 'BARREN_' || (substr(hole, 4)::INT - 1) AS site_id, 'barren_hole' AS source, lon, lat, 0 AS label FROM (SELECT hole, lon, lat FROM {_values([r[:3] for r in sites.BARREN_HOLES], 'hole, lon, lat')} UNION ALL SELECT hole, lon, lat FROM ({_TRAVERSE})))
SELECT site_id, source, round(lon, 6) AS lon, round(lat, 6) AS lat, label, lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} AS in_study_area FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def literal_points_union(spark, d):
    s = sites.labelled_sites(spark)
    return s.select("site_id", "source", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "label", spatial.in_bbox("lon", "lat", BBOX).alias("in_study_area"))


# Joins by distance

_NEAR = "near AS (SELECT point_id, sample_id, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), sample_id) AS r FROM points p JOIN samples s ON abs(p.x - s.x) <= {0} AND abs(p.y - s.y) <= {0} WHERE sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= {0})"


@query(f"WITH {POINTS}, {SAMPLES}, {_NEAR.format(1000)} SELECT p.point_id, n.sample_id, round(n.dist, 6) + 0.0 AS dist FROM points p LEFT JOIN near n ON n.point_id = p.point_id AND r = 1")
def nearest_join_1km(spark, d):
    return rounded(spatial.nearest_join(points(spark, d), samples(spark, d), left_id="point_id", right_id="sample_id").select("point_id", "sample_id", "dist"), "dist")


@query(f"WITH {POINTS}, {SAMPLES}, {_NEAR.format(10000)} SELECT p.point_id, n.sample_id, round(n.dist, 6) + 0.0 AS dist, s.zn_ppm FROM points p LEFT JOIN near n ON n.point_id = p.point_id AND r = 1 LEFT JOIN samples s ON s.sample_id = n.sample_id")
def nearest_join_assays(spark, d):
    j = spatial.nearest_join(points(spark, d), samples(spark, d), radius=10000.0, left_id="point_id", right_id="sample_id")
    return rounded(j.join(samples(spark, d).select("sample_id", "zn_ppm"), "sample_id", "left").select("point_id", "sample_id", "dist", "zn_ppm"), "dist")


@query(f"WITH {POINTS}, {SAMPLES}, {_NEAR.format(5000)} SELECT point_id, x, y FROM points WHERE point_id NOT IN (SELECT point_id FROM near)")
def nearest_join_unmatched(spark, d):
    return spatial.nearest_join(points(spark, d), samples(spark, d), radius=5000.0, left_id="point_id", right_id="sample_id").where("sample_id IS NULL").select("point_id", "x", "y")


@query(f"""WITH {POINTS}, {SAMPLES}, p AS (SELECT point_id, min(dist) AS a FROM (SELECT point_id, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist FROM points p, samples s WHERE sample_id % 2 = 0) WHERE dist <= 6000 GROUP BY 1),
n AS (SELECT point_id, min(dist) AS b FROM (SELECT point_id, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist FROM points p, samples s WHERE sample_id % 2 = 1) WHERE dist <= 2000 GROUP BY 1)
SELECT point_id, round(a, 6) + 0.0 AS nearest_positive, round(b, 6) + 0.0 AS nearest_negative, CASE WHEN a <= 2000 THEN 1 WHEN a <= 6000 THEN NULL WHEN b <= 2000 THEN 0 END AS label FROM points LEFT JOIN p USING (point_id) LEFT JOIN n USING (point_id)""")
def distance_label_rule(spark, d):
    s = samples(spark, d)
    out = spatial.label_by_distance(points(spark, d), s.where("sample_id % 2 = 0"), s.where("sample_id % 2 = 1"), point_id="point_id", site_id="sample_id", near=2000.0, far=6000.0)
    return rounded(out.select("point_id", "nearest_positive", "nearest_negative", "label"), "nearest_positive", "nearest_negative")


@query(f"WITH {POINTS}, {SAMPLES}, {_NEAR.format(3000)} SELECT sample_id, count(*) AS n_points FROM near GROUP BY 1")
def buffer_membership(spark, d):
    return spatial.near_pairs(points(spark, d), samples(spark, d), 3000.0, "point_id", "sample_id").groupBy("sample_id").agg(F.count("*").alias("n_points"))


@query(f"""WITH {SAMPLES}, c AS (SELECT sample_id, i, round(x + 500 * cos(2 * pi() * (i % 32) / 32), 3) + 0.0 AS px, round(y + 500 * sin(2 * pi() * (i % 32) / 32), 3) + 0.0 AS py FROM samples, range(33) t(i))
SELECT sample_id, 'POLYGON ((' || string_agg(px || ' ' || py, ', ' ORDER BY i) || '))' AS wkt, count(*) AS corners FROM c GROUP BY 1""")
def buffer_polygons(spark, d):
    wkt = C.buffer_wkt("x", "y", 500.0)
    return samples(spark, d).select("sample_id", wkt.alias("wkt"), F.size(F.split(wkt, ",")).cast("long").alias("corners"))


# Grids


def _grid_sql(off):
    return f"WITH {_LONLAT.split(' AS ')[0]} AS (SELECT 0 AS point_id, lon, lat FROM (VALUES ({BBOX[0]}::DOUBLE), ({BBOX[2]}::DOUBLE)) a(lon), (VALUES ({BBOX[1]}::DOUBLE), ({BBOX[3]}::DOUBLE)) b(lat)), {_FORWARD}, m AS (SELECT min(x) AS x0, max(y) AS y0, ceil((max(x) - min(x)) / 1000)::BIGINT AS w, ceil((max(y) - min(y)) / 1000)::BIGINT AS h FROM xy) SELECT i AS cell_id, (i // w)::INT AS \"row\", (i % w)::INT AS col, round(x0 + (i % w + {off}) * 1000, 3) AS x, round(y0 - (i // w + {off}) * 1000, 3) AS y FROM m, range(100000) t(i) WHERE i < w * h"


def _grid(spark, d, resolution, at="centre"):
    b = bbox_bounds(spark)
    return grid.build_grid(spark, grid.grid_over(b, resolution), at)


def bbox_bounds(spark):
    corners = spark.createDataFrame([(x, y) for x in BBOX[::2] for y in BBOX[1::2]], "lon double, lat double")
    r = spatial.bounds(spatial.project(corners)).first()
    return (r.x_min, r.y_min, r.x_max, r.y_max)


@query(_grid_sql(0.5))
def grid_centroids(spark, d):
    return _grid(spark, d, 1000.0).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


@query(_grid_sql(0.0))
def grid_corners(spark, d):
    return _grid(spark, d, 1000.0, "corner").withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


_CELL = 'pt AS (SELECT point_id, floor((150000 - y) / 1000)::INT AS "row", floor(x / 1000)::INT AS col FROM points)'


@query(f'WITH {BANDS}, {POINTS}, {_CELL} SELECT point_id, band, value FROM pt JOIN bands USING ("row", col) WHERE value IS NOT NULL')
def raster_sample_points(spark, d):
    return grid.sample_points(points(spark, d), two_bands(spark, d), META, "point_id")


@query(f"""WITH {BANDS}, {POINTS}, {_CELL} SELECT point_id, any_value(p.x) AS x, any_value(p.y) AS y, max(value) FILTER (band = 'tmi') AS tmi, max(value) FILTER (band = 'rad_k') AS rad_k FROM pt JOIN points p USING (point_id) LEFT JOIN bands USING ("row", col) GROUP BY 1""")
def raster_sample_wide(spark, d):
    return grid.sample_wide(points(spark, d), two_bands(spark, d), META, ["tmi", "rad_k"])


@query(f"WITH {BANDS} SELECT band, count(*) AS n_cells, count(value) AS n_valid, min(value) AS min, max(value) AS max, count(value) > 0 AS valid FROM bands GROUP BY 1")
def raster_validate(spark, d):
    return grid.validate(two_bands(spark, d))


@query(f"WITH {BANDS} SELECT band, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(value) AS n_valid FROM bands GROUP BY 1")
def raster_band_stats(spark, d):
    return grid.band_stats(two_bands(spark, d)).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(f"WITH {BANDS} SELECT band, round(quantile_cont(value, 0.02), 6) + 0.0 AS lo, round(quantile_cont(value, 0.98), 6) + 0.0 AS hi, round(greatest(abs(quantile_cont(value, 0.02)), abs(quantile_cont(value, 0.98))), 6) + 0.0 AS \"limit\" FROM bands GROUP BY 1")
def percentile_clip(spark, d):
    return rounded(grid.percentile_limits(two_bands(spark, d)), "lo", "hi", "limit")


@query(f"""WITH {CELLS} SELECT ("row" // 32)::INT AS tile_r, (col // 32)::INT AS tile_c, count(*) AS n, count(value) AS n_valid FROM cells GROUP BY 1, 2""")
def tile_index(spark, d):
    return grid.with_tiles(cells(spark, d), 32).groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"))


@query(f"""WITH {CELLS}, g AS (SELECT ceil((max(col) + 1) * 1000 / 1500.0)::BIGINT AS across, ceil((max("row") + 1) * 1000 / 1300.0)::BIGINT AS down FROM cells),
t AS (SELECT i AS cell_id, 300 + (i % across) * 1500.0::DOUBLE AS x, 149600 - (i // across) * 1300.0::DOUBLE AS y FROM (SELECT across, unnest(range(across * down)) AS i FROM g)),
f AS (SELECT cell_id, (150000 - y) / 1000 - 0.5 AS fr, x / 1000 - 0.5 AS fc FROM t),
k AS (SELECT cell_id, (floor(fr) + i)::INT AS "row", (floor(fc) + j)::INT AS col, CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w FROM f, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT cell_id, 'tmi' AS band, round(sum(w * value) / sum(w) FILTER (value IS NOT NULL), 4) AS value FROM k JOIN cells USING ("row", col) WHERE w > 0 GROUP BY 1""")
def raster_warp_bilinear(spark, d):
    c = cells(spark, d)
    at = extent(c)
    across, down = math.ceil(at.width * at.dx / 1500), math.ceil(at.height * at.dy / 1300)
    t = spark.range(across * down).selectExpr("id AS cell_id", f"300 + (id % {across}) * 1500D AS x", f"149600 - (id div {across}) * 1300D AS y")
    return grid.warp_bilinear(c, at, t).withColumn("value", F.round("value", 4))


_GRAD = f"""{CELLS}, v AS (SELECT *, coalesce(value, 0) AS f FROM cells),
n AS (SELECT "row", col, value, f, lag(f) OVER r AS l, lead(f) OVER r AS e, lag(f) OVER c AS u, lead(f) OVER c AS b FROM v WINDOW r AS (PARTITION BY "row" ORDER BY col), c AS (PARTITION BY col ORDER BY "row")),
g AS (SELECT "row", col, value, CASE WHEN value IS NULL THEN NULL WHEN l IS NULL AND e IS NULL THEN 0 WHEN l IS NULL THEN (e - f) / 50 WHEN e IS NULL THEN (f - l) / 50 ELSE (e - l) / 100 END AS gx, CASE WHEN value IS NULL THEN NULL WHEN u IS NULL AND b IS NULL THEN 0 WHEN u IS NULL THEN (b - f) / 50 WHEN b IS NULL THEN (f - u) / 50 ELSE (b - u) / 100 END AS gy FROM n)"""


@query(f'WITH {_GRAD} SELECT "row", col, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM g')
def gradient_2d(spark, d):
    return rounded(potential.horizontal_gradient(cells(spark, d), 50.0).select("row", "col", "gx", "gy"), "gx", "gy")


@query(f'WITH {_GRAD} SELECT "row", col, round(sqrt(gx * gx + gy * gy + 1e-10), 6) + 0.0 AS thg FROM g')
def thg(spark, d):
    return rounded(potential.horizontal_gradient(cells(spark, d), 50.0).select("row", "col", potential.total_gradient("gx", "gy").alias("thg")), "thg")


def _turn(f, sign, by, size):
    """cos or sin of a whole number of steps, by / size of a turn each, the steps taken modulo size."""
    return f"{sign}{f}(2 * pi() * ({by} % {size}) / {size})"


#: A discrete Fourier transform of the whole raster, padded to powers of two, along rows, then columns, and back the same way.
_DFT = f"""{CELLS}, z AS (SELECT pow(2, ceil(log2(max("row") + 1)))::INT AS n, pow(2, ceil(log2(max(col) + 1)))::INT AS m, avg(value) AS mean FROM cells),
i AS (SELECT unnest(range(n)) AS ki FROM z), j AS (SELECT unnest(range(m)) AS kj FROM z),
s AS (SELECT "row", col, value, coalesce(value, mean) AS f FROM cells, z),
a AS (SELECT "row", kj, sum(f * {_turn('cos', '', '(kj * col)', 'm')}) AS re, sum(f * {_turn('sin', '-', '(kj * col)', 'm')}) AS im FROM s, z, j GROUP BY 1, 2),
b AS (SELECT ki, kj, sum(re * {_turn('cos', '', '(ki * "row")', 'n')} + im * {_turn('sin', '', '(ki * "row")', 'n')}) AS re, sum(im * {_turn('cos', '', '(ki * "row")', 'n')} - re * {_turn('sin', '', '(ki * "row")', 'n')}) AS im FROM a, z, i GROUP BY 1, 2),
k AS (SELECT ki, kj, re, im, sqrt(pow(2 * pi() * (CASE WHEN ki < n // 2 THEN ki ELSE ki - n END) / (n * 50), 2) + pow(2 * pi() * (CASE WHEN kj < m // 2 THEN kj ELSE kj - m END) / (m * 50), 2)) AS k FROM b, z),
rows AS (SELECT DISTINCT "row" FROM cells), cols AS (SELECT DISTINCT col FROM cells),
d AS (SELECT "row", kj, sum(k * (re * c - im * s)) AS r1, sum(k * (re * s + im * c)) AS i1, sum(k * k * (re * c - im * s)) AS r2, sum(k * k * (re * s + im * c)) AS i2
  FROM (SELECT "row", kj, k, re, im, {_turn('cos', '', '(ki * "row")', 'n')} AS c, {_turn('sin', '', '(ki * "row")', 'n')} AS s FROM k, rows, z) GROUP BY 1, 2),
w AS (SELECT "row", col, sum(r1 * c - i1 * s) AS fvd, sum(r2 * c - i2 * s) AS svd
  FROM (SELECT "row", col, r1, i1, r2, i2, {_turn('cos', '', '(kj * col)', 'm')} AS c, {_turn('sin', '', '(kj * col)', 'm')} AS s FROM d, cols, z) GROUP BY 1, 2),
v AS (SELECT "row", col, value, fvd / (n * m) AS fvd, svd / (n * m) AS svd FROM s JOIN w USING ("row", col), z)"""


@query(f'WITH {_DFT} SELECT "row", col, CASE WHEN value IS NOT NULL THEN round(fvd, 3) + 0.0 END AS fvd, CASE WHEN value IS NOT NULL THEN round(svd, 5) + 0.0 END AS svd FROM v')
def vertical_derivatives_fft(spark, d):
    c = cells(spark, d)
    at = extent(c)
    v = potential.vertical_derivatives(c, at.height, at.width, 50.0, {"fvd": 1, "svd": 2})
    return v.select("row", "col", (F.round("fvd", 3) + 0.0).alias("fvd"), (F.round("svd", 5) + 0.0).alias("svd"))


def _edges(value, alias):
    return f"""lag({value}) OVER r AS l{alias}, lead({value}) OVER r AS e{alias}, lag({value}) OVER c AS u{alias}, lead({value}) OVER c AS b{alias}"""


def _grad_case(f, a):
    one = lambda p, q: f"CASE WHEN {p}{a} IS NULL THEN ({q}{a} - {f}) / 50 WHEN {q}{a} IS NULL THEN ({f} - {p}{a}) / 50 ELSE ({q}{a} - {p}{a}) / 100 END"
    return one("l", "e"), one("u", "b")


_W = 'WINDOW r AS (PARTITION BY "row" ORDER BY col), c AS (PARTITION BY col ORDER BY "row")'
_GX, _GY = _grad_case("z", "1")
_TX, _TY = _grad_case("tz", "2")
_ALL = f"""{_DFT}, h AS (SELECT *, coalesce(value, 0) AS z, {_edges("coalesce(value, 0)", "1")} FROM v {_W}),
t AS (SELECT "row", col, value, fvd, svd, sqrt(pow({_GX}, 2) + pow({_GY}, 2) + 1e-10) AS thg FROM h),
u AS (SELECT *, sqrt(thg * thg + fvd * fvd + 1e-10) AS "as", CASE WHEN value IS NOT NULL THEN atan2(fvd, thg + 1e-10) END AS tdr FROM t),
q AS (SELECT *, coalesce(tdr, 0) AS tz, {_edges("coalesce(tdr, 0)", "2")} FROM u {_W})"""


@query(f'WITH {_ALL} SELECT "row", col, round(thg, 4) + 0.0 AS thg, round("as", 3) + 0.0 AS "as", round(tdr, 6) + 0.0 AS tdr, round(sqrt(pow({_TX}, 2) + pow({_TY}, 2) + 1e-10), 6) + 0.0 AS thdr FROM q WHERE value IS NOT NULL')
def all_derivatives(spark, d):
    c = cells(spark, d)
    at = extent(c)
    a = potential.all_derivatives(c, at.height, at.width, 50.0).where("value IS NOT NULL")
    return a.select("row", "col", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("thg", 4), ("as", 3), ("tdr", 6), ("thdr", 6))])


# Folds and oversampling


@query(f"WITH {POINTS}, m AS (SELECT min(x) AS lo, max(x) AS hi FROM points) SELECT point_id, x, y, greatest(0, least(4, floor((x - lo) * 5 / (hi - lo))::INT)) AS fold FROM points, m")
def spatial_strip_folds(spark, d):
    return dataset.strip_folds(points(spark, d))


@query(f"WITH {POINTS}, m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM points), f AS (SELECT point_id, greatest(0, least(4, floor((x - a) * 5 / (b - a))::INT)) AS block_x, greatest(0, least(4, floor((y - c) * 5 / (d - c))::INT)) AS block_y FROM points, m) SELECT *, ((block_x + 2 * block_y) % 5)::INT AS fold FROM f")
def spatial_grid_folds(spark, d):
    return dataset.grid_folds(points(spark, d)).select("point_id", "block_x", "block_y", "fold")


@query("SELECT (row_number() OVER (ORDER BY p_partkey) - 1) AS pos, p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) % 5)::INT AS fold FROM part")
def round_robin_folds(spark, d):
    return dataset.round_robin_folds(dataset.numbered(table(spark, d, "part").select("p_partkey"), "p_partkey", "pos"), "pos").select("pos", "p_partkey", "fold")


@query("WITH t AS (SELECT p_partkey, (p_partkey % 5)::INT AS fold, p_partkey % 11 = 0 AS syn FROM part) SELECT f::INT AS test_fold, count(*) FILTER (fold <> f OR syn) AS n_train, count(*) FILTER (fold = f AND NOT syn) AS n_test FROM t, range(5) r(f) GROUP BY 1")
def fold_split_with_synthetic(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "int(p_partkey % 5) AS fold", "p_partkey % 11 = 0 AS is_synthetic")
    out = None
    for f in range(5):
        train, test = dataset.split(t, f)
        one = train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test"))).select(F.lit(f).alias("test_fold"), "n_train", "n_test")
        out = one if out is None else out.unionByName(one)
    return out


_KNN = """m AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings WHERE label = 0),
k AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_distance(a.v, b.v), 6) AS dist FROM m a JOIN m b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour)::INT AS rank FROM k QUALIFY rank <= 5)"""


def _minority(spark, d):
    return embedded(spark, d).where("label = 1").select(F.col("row_id").alias("vec_id"), "features")


@query(f"WITH {_KNN} SELECT vec_id, rank, neighbour, dist FROM n")
def smote_knn(spark, d):
    return dataset.neighbours(_minority(spark, d), "vec_id", "features")


@query(f"""WITH {_KNN}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS t FROM m),
s AS (SELECT id AS synthetic, id % (SELECT max(t) FROM o) AS i, ((id * 1103515245 + 12345) % 2147483648 % 5)::INT + 1 AS rank, ((id * 69069 + 1) % 2147483648) / 2147483648.0::DOUBLE AS u FROM range(200) r(id))
SELECT synthetic, o.vec_id AS seed, neighbour, round(u, 9) AS u, round(a.v[1] + u * (b.v[1] - a.v[1]), 6) + 0.0 AS x0, round(a.v[64] + u * (b.v[64] - a.v[64]), 6) + 0.0 AS x63
FROM s JOIN o USING (i) JOIN n ON n.vec_id = o.vec_id AND n.rank = s.rank JOIN m a ON a.vec_id = o.vec_id JOIN m b ON b.vec_id = neighbour""")
def smote_synthesize(spark, d):
    s = dataset.smote(_minority(spark, d), 200, "vec_id", "features")
    return s.select("synthetic", "seed", "neighbour", F.round("u", 9).alias("u"), r6(F.col("features")[0]).alias("x0"), r6(F.col("features")[63]).alias("x63"))


# Evaluation

_RC = f"""{SCORED}, e AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM e WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query(f"WITH {_RC} SELECT model, score AS threshold, round(fp / n::DOUBLE, 6) + 0.0 AS fpr, round(tp / p::DOUBLE, 6) + 0.0 AS tpr FROM c")
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(scored(spark, d), ["model"]), "fpr", "tpr")


def _auc(by):
    return f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS mid FROM scored),
a AS (SELECT {by}, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, sum(mid) FILTER (label = 1) AS s FROM r GROUP BY ALL) SELECT {by}, round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0) / (p * n)::DOUBLE END, 6) + 0.0 AS auc FROM a"""


@query(_auc("model"))
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d), ["model"]), "auc")


@query(_auc("model, fold"))
def roc_auc_by_fold(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d), ["model", "fold"]), "auc")


@query(f"WITH {_RC} SELECT model, score AS threshold, round(tp / p::DOUBLE, 6) + 0.0 AS recall, round(tp / (tp + fp)::DOUBLE, 6) + 0.0 AS precision, round(p / (p + n)::DOUBLE, 6) + 0.0 AS prevalence FROM c")
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(scored(spark, d), ["model"]), "recall", "precision", "prevalence")


@query(f"WITH {_RC} SELECT model, round(sum(pos / p::DOUBLE * tp / (tp + fp)), 6) + 0.0 AS ap FROM c GROUP BY 1")
def average_precision(spark, d):
    return rounded(metrics.average_precision(scored(spark, d), ["model"]), "ap")


@query(f"WITH {_RC}, q AS (SELECT model, tp / p::DOUBLE AS r, tp / (tp + fp)::DOUBLE AS y, lag(tp / p::DOUBLE, 1, 0) OVER w AS r0, lag(tp / (tp + fp)::DOUBLE, 1, 1) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY model ORDER BY score DESC)) SELECT model, round(sum((r - r0) * (y + y0) / 2), 6) + 0.0 AS pr_auc FROM q GROUP BY 1")
def pr_auc_trapezoid(spark, d):
    return rounded(metrics.pr_auc(scored(spark, d), ["model"]), "pr_auc")


_CM = f"{SCORED}, cm AS (SELECT model, fold, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM scored GROUP BY 1, 2)"


@query(f"WITH {_CM} SELECT * FROM cm")
def confusion_matrix(spark, d):
    return metrics.confusion(scored(spark, d), ["model", "fold"])


@query(f"WITH {_CM} SELECT model, fold, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) + 0.0 AS balanced_accuracy FROM cm")
def balanced_accuracy(spark, d):
    return rounded(metrics.balanced_accuracy(scored(spark, d), ["model", "fold"]), "balanced_accuracy")


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, row_id) AS k FROM scored) SELECT model, round(avg((label = 1)::INT), 6) + 0.0 AS precision_at_k FROM r WHERE k <= 45 GROUP BY 1")
def precision_at_k(spark, d):
    return rounded(metrics.precision_at(scored(spark, d), ["model"], 45, "row_id"), "precision_at_k")


_FOLD = f"""{SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY score) + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2.0 AS mid FROM scored),
a AS (SELECT model, fold, (sum(mid) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE AS roc_auc,
  (count(*) FILTER (score >= 0.5 AND label = 1) / (count(*) FILTER (label = 1))::DOUBLE + count(*) FILTER (score < 0.5 AND label = 0) / (count(*) FILTER (label = 0))::DOUBLE) / 2 AS balanced_acc FROM r GROUP BY 1, 2),
e AS (SELECT model, fold, score, count(*) FILTER (label = 1) AS pos, count(*) AS c FROM scored GROUP BY 1, 2, 3),
f AS (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS s, sum(pos) OVER (PARTITION BY model, fold) AS p FROM e WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)),
b AS (SELECT model, fold, sum(pos / p::DOUBLE * tp / s) AS avg_prec FROM f GROUP BY 1, 2),
pf AS (SELECT * FROM a JOIN b USING (model, fold)),
sm AS (SELECT model, avg(roc_auc) AS roc_auc_mean, stddev_pop(roc_auc) AS roc_auc_std, avg(avg_prec) AS avg_prec_mean, stddev_pop(avg_prec) AS avg_prec_std, avg(balanced_acc) AS balanced_acc_mean, stddev_pop(balanced_acc) AS balanced_acc_std FROM pf GROUP BY 1)"""
_M = ["roc_auc_mean", "roc_auc_std", "avg_prec_mean", "avg_prec_std", "balanced_acc_mean", "balanced_acc_std"]


def _summary(spark, d):
    return metrics.summary(metrics.fold_metrics(scored(spark, d)))


@query(f"WITH {_FOLD} SELECT model, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _M) + " FROM sm")
def fold_metric_summary(spark, d):
    return rounded(_summary(spark, d), *_M)


@query(f"WITH {_FOLD}, w AS (SELECT m AS metric, max(CASE WHEN model = 'rf' THEN v END) AS a, max(CASE WHEN model = 'xgb' THEN v END) AS b FROM (" + " UNION ALL ".join(f"SELECT model, '{m}' AS m, {m}_mean AS v FROM sm" for m in ("roc_auc", "avg_prec", "balanced_acc")) + ") GROUP BY 1) SELECT metric, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, CASE WHEN a > b THEN 'rf' ELSE 'xgb' END AS winner FROM w")
def model_compare_winner(spark, d):
    return rounded(metrics.winners(_summary(spark, d), "rf", "xgb"), "a", "b")


@query(f"WITH {_FOLD} SELECT model, round(roc_auc_mean, 6) + 0.0 AS roc_auc_mean FROM sm ORDER BY sm.roc_auc_mean DESC, model = 'rf' DESC LIMIT 1")
def best_model_select(spark, d):
    return rounded(metrics.best_model(_summary(spark, d), "rf"), "roc_auc_mean")


_PROB = "(o_totalprice % 1000) / 1000"


@query(f"WITH p AS (SELECT {_PROB} AS p FROM orders) SELECT count(p) AS n, round(min(p), 6) + 0.0 AS min, round(max(p), 6) + 0.0 AS max, round(median(p), 6) + 0.0 AS median, round(avg(p), 6) + 0.0 AS mean, " + ", ".join(f"count(*) FILTER (p > {t}) AS over_{int(t * 100)}, round(100 * count(*) FILTER (p > {t}) / count(p)::DOUBLE, 6) + 0.0 AS percent_{int(t * 100)}" for t in (0.5, 0.7, 0.9)) + " FROM p")
def map_threshold_stats(spark, d):
    m = metrics.map_summary(table(spark, d, "orders").selectExpr(f"{_PROB} AS prob"))
    return rounded(m, "min", "max", "median", "mean", "percent_50", "percent_70", "percent_90")


@query(f"SELECT o_orderkey, CASE WHEN {_PROB} > 0.9 THEN 'high' WHEN {_PROB} > 0.7 THEN 'moderate' WHEN {_PROB} > 0.5 THEN 'low' ELSE 'background' END AS class FROM orders")
def legend_classes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.legend_class(F.expr(_PROB)).alias("class"))


_IMP = "i AS (SELECT p_brand AS model, p_type AS feature, round(avg(p_retailprice), 6) AS importance FROM part GROUP BY 1, 2)"


def _importances(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("feature")).agg(F.round(F.avg("p_retailprice"), 6).alias("importance"))


@query(f"WITH {_IMP} SELECT model, feature, importance, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature)::INT AS rank FROM i QUALIFY rank <= 3")
def topk_importance(spark, d):
    return metrics.top_features(_importances(spark, d), 3)


@query(f"WITH {_IMP}, t AS (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS r FROM i) SELECT feature, count(*) AS n_models FROM t WHERE r <= 3 GROUP BY 1")
def topk_union(spark, d):
    return metrics.top_features(_importances(spark, d), 3).groupBy("feature").agg(F.count("*").alias("n_models"))


# Sources and sinks


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, value AS longitude, (event_id % 90)::DOUBLE AS latitude FROM events WHERE event_id % 9 <> 0")
def json_flatten_features(spark, d):
    e = table(spark, d, "events")
    place = F.struct(F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("x"), (F.col("event_id") % 90).cast("double").alias("y"))
    attributes = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_id"), F.col("event_id").cast("string")))
    pages = e.select(F.to_json(F.struct(F.array(F.struct(attributes.alias("attributes"), place.alias("geometry"))).alias("features"))).alias("page"))
    flat = files.flatten_pages(pages.select(F.from_json("page", files.PAGE_SCHEMA).alias("p")).select("p.features"))
    return flat.select(F.col("attributes")["event_id"].cast("long").alias("event_id"), F.col("attributes")["k"].cast("long").alias("k"), "longitude", "latitude")


@query("SELECT 'raster_' || p_partkey || '.tif' AS name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def missing_files_antijoin(spark, d):
    name = lambda c: F.concat(F.lit("raster_"), F.col(c), F.lit(".tif")).alias("name")
    return files.missing(table(spark, d, "part").select(name("p_partkey")), table(spark, d, "supplier").select(name("s_suppkey")))


@query(f"""WITH {SAMPLES} SELECT '{{"type":"Feature","properties":{{"sample_id":' || sample_id || '}},"geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}}}}' AS feature FROM samples WHERE x < 1e7""")
def geojson_export(spark, d):
    return files.geojson(samples(spark, d), "x", "y", ["sample_id"])


@query(f"WITH {SAMPLES} SELECT sample_id, x, y FROM samples WHERE x BETWEEN {ENVELOPE[0]} - 2300000 AND {ENVELOPE[2]} - 2690000 AND y BETWEEN {ENVELOPE[1]} - 7400000 AND {ENVELOPE[3]} - 7600000")
def envelope_filter(spark, d):
    return samples(spark, d).where(spatial.in_bbox("x", "y", (ENVELOPE[0] - 2300000, ENVELOPE[1] - 7400000, ENVELOPE[2] - 2690000, ENVELOPE[3] - 7600000))).select("sample_id", "x", "y")


# The whole matrix, models, explanations


def features_at(spark, d, places, place_id, line, order) -> DataFrame:
    """places (id, x, y) with sampled bands, the nearest assay and all engineered columns: the same for training and scoring.
    Gradients run along ``order`` in each line."""
    p = grid.sample_wide(places, two_bands(spark, d), META, ["tmi", "rad_k"]).withColumnRenamed("tmi", "mag_tmi")
    p = spatial.nearest_join(p, samples(spark, d), radius=10000.0, left_id=place_id, right_id="sample_id").join(samples(spark, d).select("sample_id", "zn_ppm"), "sample_id", "left")
    return features.engineer(p.withColumn("line", line), series=["line"], order=order)


def stored(spark, df: DataFrame) -> DataFrame:
    """df, written once to a folder that driver and executors share, for what reads it many times."""
    kept = files.materialized(lambda: df, f"{shared_dir(spark)}/orespark/{uuid.uuid4().hex}", spark)
    relieve_driver(spark)
    return kept


def feature_matrix(spark, d) -> DataFrame:
    return features_at(spark, d, points(spark, d), "point_id", F.floor(F.col("y") / 10000), "point_id")


_MATRIX = f"""{BANDS}, {POINTS}, {SAMPLES}, {_CELL}, {_NEAR.format(10000)},
w AS (SELECT point_id, max(value) FILTER (band = 'tmi') AS mag_tmi, max(value) FILTER (band = 'rad_k') AS rad_k FROM pt LEFT JOIN bands USING ("row", col) GROUP BY 1),
m AS (SELECT p.point_id, mag_tmi, rad_k, s.zn_ppm, floor(p.y / 10000) AS line, coalesce(mag_tmi, 0) AS t FROM points p JOIN w USING (point_id) LEFT JOIN near n ON n.point_id = p.point_id AND r = 1 LEFT JOIN samples s ON s.sample_id = n.sample_id),
l AS (SELECT *, lag(t) OVER o AS b, lead(t) OVER o AS f FROM m WINDOW o AS (PARTITION BY line ORDER BY point_id)),
g AS (SELECT *, CASE WHEN b IS NULL AND f IS NULL THEN 0 WHEN b IS NULL THEN f - t WHEN f IS NULL THEN t - b ELSE (f - b) / 2 END AS g FROM l), x AS (SELECT avg(zn_ppm) AS a, stddev_samp(zn_ppm) AS d FROM g)"""


@query(f"""WITH {_MATRIX} SELECT point_id, mag_tmi, rad_k, zn_ppm, {R.format('sqrt(g * g + 1e-12 + 1e-6)')} AS mag_hgm, {R.format('sqrt(2 * g * g + 1e-12 + 1e-6)')} AS mag_as, {R.format('coalesce(rad_k, 0) / 1e-6')} AS rad_k_th,
CASE WHEN zn_ppm IS NOT NULL THEN {R.format('log10(greatest(zn_ppm, 1e-6))')} END AS log_zn_ppm, {R.format('coalesce((zn_ppm - a) / (d + 1e-6), 0) / 6')} AS geochem_meas FROM g, x""")
def feature_matrix_full(spark, d):
    return rounded(feature_matrix(spark, d).select("point_id", "mag_tmi", "rad_k", "zn_ppm", "mag_hgm", "mag_as", "rad_k_th", "log_zn_ppm", "geochem_meas"), "mag_hgm", "mag_as", "rad_k_th", "log_zn_ppm", "geochem_meas")


_FOREST = {"numTrees": 20, "maxDepth": 5}
_NAMES = [f"f{i}" for i in range(64)]


@query()
def rf_scores(spark, d):
    return models.out_of_fold(embedded(spark, d), "rf", 5, **_FOREST)


@query()
def gbt_scores(spark, d):
    return models.out_of_fold(embedded(spark, d), "gbt", FOLDS, maxIter=5, maxDepth=3)


@query()
def rf_importance(spark, d):
    return models.importances(models.fit(embedded(spark, d), "rf", **_FOREST), _NAMES, "rf")


@query()
def hpo_trials(spark, d):
    return models.search(embedded(spark, d), "rf", FOLDS, TRIALS)


#: Features that the fixture tables can give.
TRAINED = ["mag_tmi", "rad_k", "zn_ppm", "mag_hgm", "mag_as", "rad_k_th", "log_zn_ppm", "geochem_meas"]


def study_grid(spark, d) -> DataFrame:
    """The centres of the raster's cells."""
    return grid.build_grid(spark, extent(two_bands(spark, d)))


def grid_features_at(spark, d) -> DataFrame:
    g = study_grid(spark, d)
    return features_at(spark, d, g.drop("row", "col"), "cell_id", F.expr("cell_id div 100"), "cell_id")


def trained(spark, d, kind="rf", **params) -> models.Bundle:
    """A model of the labelled points, saved and loaded again."""
    rows = dataset.labelled(stored(spark, feature_matrix(spark, d)).withColumn("label", (F.col("point_id") % 7 == 0).cast("int")))
    folder = f"{shared_dir(spark)}/orespark/{uuid.uuid4().hex}"
    models.train(rows, TRAINED, kind, **params).save(folder)
    return models.load(spark, folder)


@query()
def grid_scoring(spark, d):
    """Every cell of the raster, with the engineered features that a model was trained on, missing ones filled as then, scored and
    classed by the legend."""
    bundle = trained(spark, d, numTrees=10, maxDepth=4)
    return bundle.score(grid_features_at(spark, d), ["cell_id", "x", "y"]).withColumn("class", C.legend_class("score"))


def _shap(spark, d):
    data = embedded(spark, d)
    return data, explain.shap_values(models.fit(data, "rf", numTrees=10, maxDepth=4), data, _NAMES, shared_dir(spark))


@query()
def shap_values(spark, d):
    return _shap(spark, d)[1]


@query()
def shap_ranking(spark, d):
    return explain.ranking(_shap(spark, d)[1], _NAMES)


@query()
def shap_dependence(spark, d):
    data, shap = _shap(spark, d)
    top = [r.feature for r in explain.ranking(shap, _NAMES, 4).collect()]
    return explain.long_form(shap, data, _NAMES).where(F.col("feature").isin(top))


@query(f"SELECT 47.25::DOUBLE + (o_orderkey * 7919 % 6000) / 10000 AS lat, -66.7::DOUBLE + (o_orderkey * 104729 % 13000) / 10000 AS lon, {_PROB} AS intensity FROM orders")
def heat_points(spark, d):
    c = table(spark, d, "orders").selectExpr("47.25D + (o_orderkey * 7919 % 6000) / 10000 AS lat", "-66.7D + (o_orderkey * 104729 % 13000) / 10000 AS lon", f"{_PROB} AS p")
    point = F.col("point")
    return files.heat_points(c, "lat", "lon", "p").select(point[0].alias("lat"), point[1].alias("lon"), point[2].alias("intensity"))


from . import workflows  # noqa: E402, F401  (registers its queries)
