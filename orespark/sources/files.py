"""Files and saved pages: discovery, missing files, cached tables, CSV, GeoJSON. Paths are any that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import PAGE, RASTER_EXTENSIONS


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = RASTER_EXTENSIONS) -> DataFrame:
    """path, name, length of the files with such an extension, sorted by path."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    return found.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")).withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("path")


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, parts) -> None:
    """A file of these pieces of bytes, one after the other."""
    target, fs = hadoop_path(spark, path)
    out = fs.create(target, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def resolve(spark: SparkSession, source: str, folder: str) -> str:
    """The path of a source: as it is if it is absolute, else below the folder; an error if there is no such file."""
    path = source if source.startswith("/") or "://" in source else f"{folder.rstrip('/')}/{source}"
    target, fs = hadoop_path(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """The names in a file without a header, in its order: a small file, the features of a model."""
    return [r.value.strip() for r in spark.read.text(path, wholetext=False).coalesce(1).collect() if r.value.strip()]


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found, "name", "left_anti")


def materialized(df_maker, path: str, spark: SparkSession) -> DataFrame:
    """The table at path; made and written there first if it isn't there yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df_maker().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write df over a table that it may itself read: to a path beside it first, which then takes its place. The old table is moved
    aside and deleted last; where a run stopped before that, it is still there as path.old."""
    spark = df.sparkSession
    target, fs = hadoop_path(spark, path)
    new, old = (hadoop_path(spark, f"{path}.{end}")[0] for end in ("new", "old"))
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        raise OSError(f"{path}.new can't be moved to its place")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """One sorted CSV file with a header, for small tables such as metrics and importances."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def geojson(points: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """feature: a GeoJSON point with these properties for each row."""
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"))
    return points.select(F.to_json(shape).alias("feature"))


def heat_points(cells: DataFrame, lat: str, lon: str, intensity: str) -> DataFrame:
    return cells.select(F.array(lat, lon, intensity).alias("point"))


PAGE_SCHEMA = "features array<struct<attributes:map<string,string>,geometry:struct<x:double,y:double>>>"


def flatten_pages(pages: DataFrame) -> DataFrame:
    """From rows of PAGE_SCHEMA: attributes, longitude, latitude of each feature that has a place."""
    each = pages.select(F.explode("features").alias("f")).select(F.col("f.attributes").alias("attributes"), F.col("f.geometry.x").alias("longitude"), F.col("f.geometry.y").alias("latitude"))
    return each.where("longitude is not null and latitude is not null")


def write_layer_pages(spark: SparkSession, features: DataFrame, folder: str, order: str, x: str, y: str) -> None:
    """Save a layer (attributes: all columns but x and y) as pages of PAGE features, each a file of its own, and its count."""
    from ..operators.dataset import numbered

    rest = [c for c in features.columns if c not in (x, y)]
    feature = F.struct(F.struct(*rest).alias("attributes"), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("geometry"))
    one = numbered(features, order, "_at").select(F.expr(f"_at div {PAGE}").alias("page"), F.struct("_at", feature.alias("f")).alias("row"))
    pages = one.groupBy("page").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.count("*").alias("n"))
    count = 0
    for r in pages.select("page", "n", F.to_json(F.struct(F.transform("rows", lambda z: z["f"]).alias("features"))).alias("json")).toLocalIterator():
        write_bytes(spark, f"{folder}/page-{r.page:05d}.json", [r.json.encode()])
        count += r.n
    write_bytes(spark, f"{folder}/count.json", [json.dumps({"count": count}).encode()])


def layer_count(spark: SparkSession, folder: str) -> int:
    """How many features a saved layer has, without its pages."""
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/count.json").collect())).get("count", 0)


def read_pages(spark: SparkSession, folder: str, envelope: tuple[float, float, float, float] | None = None) -> DataFrame:
    """attributes (map), longitude, latitude of a saved layer's features that have a place, inside the envelope (x_min, y_min, x_max,
    y_max) if one is given. As many pages are read as the count asks for, each by a task; a page that isn't there is the end."""
    names = [f"{folder}/page-{i:05d}.json" for i in range(-(-layer_count(spark, folder) // PAGE))]
    there = [n for n in names if hadoop_path(spark, n)[1].exists(hadoop_path(spark, n)[0])]
    if not there:
        return flatten_pages(spark.createDataFrame([], PAGE_SCHEMA))
    flat = flatten_pages(spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(there))
    return flat if envelope is None else flat.where(F.col("longitude").between(envelope[0], envelope[2]) & F.col("latitude").between(envelope[1], envelope[3]))


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        box = options.get("envelope")
        self.box = tuple(map(float, box.split(","))) if box else None

    def partitions(self):
        """As many as the layer's count asks for."""
        fs, folder = self.place()
        count = json.loads(fs.open_input_stream(f"{folder}/count.json").read()).get("count", 0)
        return [_Page(i) for i in range(-(-count // PAGE))] or [_Page(0)]

    def place(self):
        """The file system of the folder, and the folder in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if ":" in self.folder else f"file://{self.folder}")

    def read(self, partition):
        from pyarrow import fs

        store, folder = self.place()
        path = f"{folder}/page-{partition.number:05d}.json"
        if store.get_file_info(path).type == fs.FileType.NotFound:  # a short or absent page is the end
            return
        for feature in json.loads(store.open_input_stream(path).read()).get("features", []):
            place = feature.get("geometry") or {}
            x, y = place.get("x"), place.get("y")
            if self.box is None or (x is not None and y is not None and self.box[0] <= x <= self.box[2] and self.box[1] <= y <= self.box[3]):
                yield (json.dumps(feature.get("attributes", {}), sort_keys=True), x, y)


class PagedLayer(DataSource):
    """A layer saved page by page (count.json, page-00000.json, ...): format("paged_layer"), a task for each page. The option
    envelope ("x_min,y_min,x_max,y_max") leaves out what lies outside where it is read."""

    @classmethod
    def name(cls):
        return "paged_layer"

    def schema(self):
        return "attributes string, longitude double, latitude double"

    def reader(self, schema):
        return _PageReader(self.options)
