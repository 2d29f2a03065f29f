"""Raster files: ASCII grids and GeoTIFF (one band, float32, tiles or strips; none, LZW or deflate), as rows of cells."""

from __future__ import annotations

import json
import pickle
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NODATA, TILE, GridMeta
from ..session import relieve_driver, shared_dir
from .files import write_bytes

CELLS = "path string, row int, col int, value double"
#: Bytes of packed tiles that the driver gets at once, about.
PASSED_BYTES = 2 << 20


def parse_ascii(text: str) -> tuple[GridMeta, np.ndarray]:
    head, lines = {}, text.splitlines()
    while lines and lines[0].split() and lines[0].split()[0][0].isalpha():
        k, v = lines.pop(0).split()[:2]
        head[k.lower()] = float(v)
    size, h, w = head["cellsize"], int(head["nrows"]), int(head["ncols"])
    x0 = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2)
    y1 = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2)
    meta = GridMeta(x0, y1 + h * size, size, size, w, h, nodata=head.get("nodata_value", NODATA))
    grid = np.array(" ".join(lines).split(), float).reshape(h, w)
    return meta, np.where(grid == meta.nodata, np.nan, grid)


def ascii_head(meta: GridMeta) -> str:
    return f"ncols {meta.width}\nnrows {meta.height}\nxllcorner {meta.x0!r}\nyllcorner {meta.y0 - meta.height * meta.dy!r}\ncellsize {meta.dx!r}\nNODATA_value {meta.nodata!r}\n"


def format_ascii(meta: GridMeta, grid: np.ndarray) -> str:
    return ascii_head(meta) + "\n".join(" ".join(repr(float(v)) for v in row) for row in np.where(np.isnan(grid), meta.nodata, grid)) + "\n"


def lzw_decode(data: bytes) -> bytes:
    out, table, width, bits, have, prior = bytearray(), [], 9, 0, 0, None
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            code = bits >> (have - width) & ((1 << width) - 1)
            have -= width
            bits &= (1 << have) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, prior = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            entry = table[code] if code < len(table) else prior + prior[:1]
            out += entry
            if prior is not None:
                table.append(prior + entry[:1])
            prior = entry
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            out.append(bits >> (have - 8) & 255)
            have -= 8
        bits &= (1 << have) - 1

    def fresh():
        return {bytes([i]): i for i in range(256)}, 258, 9

    table, following, width = fresh()
    put(256, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        width = 9 + (following >= 512) + (following >= 1024) + (following >= 2048)
        if following >= 4094:
            put(256, width)
            table, following, width = fresh()
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        width = 9 + (following >= 512) + (following >= 1024) + (following >= 2048)
    put(257, width)
    if have:
        put(0, 8 - have)
    return bytes(out)


#: Bytes and struct codes of the TIFF field types that are read.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_UNPACK = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}


@dataclass
class Layout:
    """What a GeoTIFF's directory says: its place, how cells are stored, and where each block of them is."""

    meta: GridMeta
    codec: int
    dtype: str
    tile: tuple[int, int]
    blocks: list[tuple[int, int]]
    text: str

    def place(self, k: int) -> tuple[int, int]:
        """The row and column that block k begins at."""
        across = -(-self.meta.width // self.tile[1])
        return k // across * self.tile[0], k % across * self.tile[1]

    def decode(self, k: int, data: bytes) -> np.ndarray:
        """The cells of block k that lie in the raster, NaN where there is no value."""
        r, c = self.place(k)
        th, tw = self.tile
        block = np.frombuffer(_UNPACK[self.codec](data), self.dtype).astype(float)
        block = block[: len(block) // tw * tw].reshape(-1, tw)[: min(th, self.meta.height - r), : self.meta.width - c]
        return np.where(block == self.meta.nodata, np.nan, block)


def layout(data: bytes) -> Layout:
    end = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(end + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(end + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            place = struct.unpack(end + "I", data[place : place + 4])[0]
        raw = data[place : place + size * count]
        tags[tag] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{end}{count}{code}", raw)
    w, h = tags[256][0], tags[257][0]
    dtype = {(32, 3): "f4", (64, 3): "f8", (16, 2): "i2", (16, 1): "u2", (32, 2): "i4", (8, 1): "u1"}[tags[258][0], tags.get(339, (1,))[0]]
    tile, offsets, counts = ((tags[323][0], tags[322][0]), tags[324], tags[325]) if 324 in tags else ((tags.get(278, (h,))[0], w), tags[273], tags[279])
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    meta = GridMeta(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], w, h, nodata=float(tags[42113]) if 42113 in tags else NODATA)
    return Layout(meta, tags.get(259, (1,))[0], end + dtype, tile, list(zip(offsets, counts)), tags.get(270, ""))


def read_tiff(data: bytes) -> tuple[GridMeta, np.ndarray, dict]:
    """The first band, its place, and the text of its description tag as a dict."""
    said = layout(data)
    grid = np.full((said.meta.height, said.meta.width), np.nan)
    for k, (o, n) in enumerate(said.blocks):
        r, c = said.place(k)
        block = said.decode(k, data[o : o + n])
        grid[r : r + block.shape[0], c : c + block.shape[1]] = block
    return said.meta, grid, tags_of(said)


def tags_of(said: Layout) -> dict:
    """The text of the description tag as a dict."""
    return json.loads(said.text) if said.text.startswith("{") else {}


def read_tags(spark: SparkSession, path: str) -> dict:
    """The tags of a GeoTIFF, of which a task reads the directory: the driver gets these alone, not the file."""
    def tags(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"tags": [json.dumps(tags_of(layout(bytes(content))))]})

    return json.loads(spark.read.format("binaryFile").load(path).select("content").mapInPandas(tags, "tags string").first().tags)


def write_tiff(meta: GridMeta, grid: np.ndarray, tags: dict | None = None, epsg: int = 2953, compress: bool = True) -> bytes:
    """A tiled float32 GeoTIFF, LZW-compressed; missing cells get the nodata value, tags go into the description as JSON."""
    down, across = -(-meta.height // TILE), -(-meta.width // TILE)
    wide = np.full((down * TILE, across * TILE), np.nan)
    wide[: meta.height, : meta.width] = grid
    blocks = [pack_tile(wide[r * TILE : (r + 1) * TILE, c * TILE : (c + 1) * TILE], meta.nodata, compress) for r in range(down) for c in range(across)]
    return tiff_head(meta, [len(b) for b in blocks], tags, epsg, compress) + b"".join(blocks)


def pack_tile(tile: np.ndarray, nodata: float, compress: bool = True) -> bytes:
    data = np.where(np.isnan(tile), nodata, tile).astype("<f4").tobytes()
    return lzw_encode(data) if compress else data


def tiff_head(meta: GridMeta, sizes: list[int], tags: dict | None, epsg: int, compress: bool) -> bytes:
    """All that stands before the tiles, which follow row by row in these sizes."""
    nodata = f"{meta.nodata:g}".encode() + b"\0"
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    fields = [
        (256, 4, (meta.width,)), (257, 4, (meta.height,)), (258, 3, (32,)), (259, 3, (5 if compress else 1,)), (262, 3, (1,)),
        (270, 2, json.dumps(tags or {}, sort_keys=True).encode() + b"\0"), (277, 3, (1,)), (322, 3, (TILE,)), (323, 3, (TILE,)),
        (324, 4, None), (325, 4, tuple(sizes)), (339, 3, (3,)), (33550, 12, (meta.dx, meta.dy, 0.0)),
        (33922, 12, (0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0)), (34735, 3, keys), (42113, 2, nodata),
    ]
    start = 8 + 2 + 12 * len(fields) + 4
    for _ in range(2):  # the first time to learn where the blocks begin
        directory, extra = struct.pack("<H", len(fields)), b""
        for tag, kind, values in fields:
            values = values if values is not None else (0,) * len(sizes)
            raw = values if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind][1]}", *values)
            directory += struct.pack("<HHI", tag, kind, len(values))
            if len(raw) <= 4:
                directory += raw.ljust(4, b"\0")
            else:
                directory += struct.pack("<I", start + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        first = start + len(extra)
        offsets = tuple(first + at for at in accumulate([0, *sizes[:-1]]))
        fields = [(t, k, offsets if t == 324 else v) for t, k, v in fields]
    return b"II*\0" + struct.pack("<I", 8) + directory + struct.pack("<I", 0) + extra


def read_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """path, row, col, value of every raster file in a folder; missing cells are NULL. A file's directory tells where its tiles are;
    these are dealt out and decoded by a task each. An ASCII grid is one tile. A file is read whole by one task to be cut."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(asc|grd|tif|tiff)$")).select("path", "content")

    def cut(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content)
                if path.lower().endswith((".tif", ".tiff")):
                    said = layout(content)
                    for k, (o, n) in enumerate(said.blocks):
                        yield pd.DataFrame({"path": [path], "k": [k], "layout": [pickle.dumps((vars(said.meta), said.codec, said.dtype, said.tile))], "data": [content[o : o + n]]})
                else:
                    yield pd.DataFrame({"path": [path], "k": [0], "layout": [b""], "data": [content]})

    def decode(batches):
        for pdf in batches:
            for path, k, said, data in zip(pdf["path"], pdf["k"], pdf["layout"], pdf["data"]):
                if len(said):
                    meta, *stored = pickle.loads(bytes(said))
                    said = Layout(GridMeta(**meta), *stored, [], "")
                    (r, c), grid = said.place(k), said.decode(k, bytes(data))
                else:
                    r, c, grid = 0, 0, parse_ascii(bytes(data).decode())[1]
                lines = max(1, TILE * TILE // max(1, grid.shape[1]))
                for top in range(0, len(grid), lines):
                    part = grid[top : top + lines]
                    down, across = (np.arange(a, a + n) for a, n in zip((r + top, c), part.shape))
                    yield pd.DataFrame({"path": path, "row": np.repeat(down, len(across)), "col": np.tile(across, len(down)), "value": part.ravel()})

    tiles = files.mapInPandas(cut, "path string, k int, layout binary, data binary").repartition("path", "k")
    return tiles.mapInPandas(decode, CELLS).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def write_raster(cells: DataFrame, meta: GridMeta, path: str, tags: dict | None = None, epsg: int = 2953) -> None:
    """One file of a band (row, col, value). Tiles are packed by a task each and pass the driver one after the other, about
    PASSED_BYTES at once; lines of an ASCII grid one after the other."""
    spark = cells.sparkSession
    held = cells.where("value is not null").where(f"row >= 0 and col >= 0 and row < {meta.height} and col < {meta.width}").select("row", "col", "value")
    if path.endswith(".asc"):
        def line(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.full(meta.width, meta.nodata)
            out[pdf["col"]] = pdf["value"]
            return pd.DataFrame({"row": [int(pdf["row"].iloc[0])], "line": [" ".join(repr(float(v)) for v in out)]})

        made = held.groupBy("row").applyInPandas(line, "row int, line string").orderBy("row")
        empty = (" ".join([repr(float(meta.nodata))] * meta.width) + "\n").encode()

        def parts():
            yield ascii_head(meta).encode()
            at = 0
            for r in made.toLocalIterator():
                yield empty * (r.row - at) + r.line.encode() + b"\n"
                at = r.row + 1
            yield empty * (meta.height - at)

        write_bytes(spark, path, parts())
        return
    across, down = -(-meta.width // TILE), -(-meta.height // TILE)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        tile = np.full((TILE, TILE), np.nan)
        tile[pdf["row"] % TILE, pdf["col"] % TILE] = pdf["value"]
        return pd.DataFrame({"k": [k], "data": [pack_tile(tile, meta.nodata)]})

    made = held.withColumn("k", F.expr(f"int(row div {TILE} * {across} + col div {TILE})")).groupBy("k").applyInPandas(pack, "k int, data binary")
    with_all = spark.read.schema("k int, data binary").parquet(_kept(made))
    blank = pack_tile(np.full((TILE, TILE), np.nan), meta.nodata)
    sizes = {r.k: r.n for r in with_all.select("k", F.length("data").alias("n")).collect()}

    def parts():
        yield tiff_head(meta, [sizes.get(k, len(blank)) for k in range(across * down)], tags, epsg, True)
        at = 0
        few = with_all.repartitionByRange(1 + sum(sizes.values()) // PASSED_BYTES, "k").sortWithinPartitions("k")
        for r in few.toLocalIterator():
            yield blank * (r.k - at) + bytes(r.data)
            at = r.k + 1
        yield blank * (across * down - at)

    write_bytes(spark, path, parts())
    relieve_driver(spark)


def _kept(df: DataFrame) -> str:
    """df written down in the shared folder: its path."""
    path = f"{shared_dir(df.sparkSession)}/orespark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    relieve_driver(df.sparkSession)
    return path
