"""GeoPackage point layers, over sqlite3."""

from __future__ import annotations

import sqlite3
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .files import write_bytes

_SQL = {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def encode_point(x: float, y: float, srs: int) -> bytes:
    return b"GP\0\x01" + struct.pack("<i", srs) + struct.pack("<BIdd", 1, 1, x, y)


def decode_point(blob: bytes) -> tuple[float, float] | None:
    size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
    end = "<" if blob[8 + size] == 1 else ">"
    kind, x, y = struct.unpack(end + "Idd", blob[9 + size : 29 + size])
    return (x, y) if kind % 1000 == 1 else None


def _database(srs: int, layer: str, fields: list) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.executescript(
        """PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"""
    )
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
    db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, ' + ", ".join(f'"{n}" {_SQL.get(k, "TEXT")}' for n, k in fields) + ")")
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', ?, 0, 0)", (layer, srs))
    return db


def write_layer(points: DataFrame, path: str, layer: str, srs: int = 2953, x: str = "x", y: str = "y", rows: int = 1_000_000) -> None:
    """points as one layer: of a file, path, if they are at most ``rows``; else of several in the folder path, each made by a task.
    A file is as large as a task's memory takes."""
    spark = points.sparkSession
    fields = [(f.name, f.dataType.simpleString()) for f in points.schema if f.name not in (x, y)]
    files = -(-points.count() // rows)

    def made(batches):
        db = _database(srs, layer, fields)
        put = f'INSERT INTO "{layer}" (geom, ' + ", ".join(f'"{n}"' for n, _ in fields) + ") VALUES (" + ", ".join("?" * (len(fields) + 1)) + ")"
        for batch in batches:
            places = zip(batch.column(x).to_pylist(), batch.column(y).to_pylist())
            values = zip(*[batch.column(n).to_pylist() for n, _ in fields]) if fields else ((),) * batch.num_rows
            db.executemany(put, [(encode_point(a, b, srs) if a is not None and b is not None else None, *v) for (a, b), v in zip(places, values)])
        db.commit()
        yield pa.RecordBatch.from_arrays([pa.array([db.serialize()], pa.binary())], names=["content"])

    blobs = (points.coalesce(1) if files <= 1 else points.repartition(files)).mapInArrow(made, "content binary")
    for i, r in enumerate(blobs.toLocalIterator()):
        write_bytes(spark, path if files <= 1 else f"{path}/part-{i:05d}.gpkg", [r.content])


def read_layer(spark: SparkSession, path: str, layer: str, schema: str) -> DataFrame:
    """x, y and the columns of ``schema`` of a layer of points; path is a file, or a folder of files, each read by a task."""
    kind = StructType.fromDDL(f"x double, y double, {schema}")
    names = ", ".join(f'"{f.name}"' for f in kind[2:])

    def rows(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                geom = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
                found = db.execute(f'SELECT "{geom}", {names} FROM "{layer}"')
                while some := found.fetchmany(10_000):
                    each = [(*((decode_point(r[0]) if r[0] else None) or (None, None)), *r[1:]) for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*each), kind)], names=kind.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, kind)
