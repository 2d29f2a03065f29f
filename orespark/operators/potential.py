"""Derivatives of potential-field grids (band, row, col, value).

Gradients are windows along rows and columns. Vertical derivatives go through a two-dimensional FFT in three passes over
blocks of arrays: along rows, along columns (where the spectrum is multiplied and transformed back), and along rows again.
A task holds a block of rows or columns, never the grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS_GRID

#: Rows, or columns of the spectrum, in a block.
BLOCK = 64


def gradient(value: str | Column, by: list[str], order: str, spacing: float = 1.0) -> Column:
    """Central differences in the order, one-sided at the ends; 0 for a single row."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value) if isinstance(value, str) else value
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - v) / spacing).when(after.isNull(), (v - before) / spacing).otherwise((after - before) / (2 * spacing))


def horizontal_gradient(cells: DataFrame, dx: float, value: str = "value", null_safe: bool = False) -> DataFrame:
    """cells with gx (along columns) and gy (along rows). Missing cells count as 0 for their neighbours and have no gradient
    themselves; null_safe=True gives none to their neighbours either."""
    filled = cells.withColumn("_v", F.col(value) if null_safe else F.coalesce(F.col(value), F.lit(0.0)))
    if null_safe:
        filled = filled.withColumn("_v", F.coalesce("_v", F.lit(float("nan"))))
    out = filled.withColumn("gx", gradient("_v", ["band", "row"], "col", dx)).withColumn("gy", gradient("_v", ["band", "col"], "row", dx))
    keep = F.col(value).isNotNull()
    for g in ("gx", "gy"):
        out = out.withColumn(g, F.when(keep & ~F.isnan(g), F.col(g)))
    return out.drop("_v")


def total_gradient(gx, gy, eps: float = EPS_GRID) -> Column:
    return F.sqrt(F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy) + F.lit(eps))


def padded(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def vertical_derivatives(cells: DataFrame, height: int, width: int, dx: float, orders: dict[str, int], demean: bool = False) -> DataFrame:
    """cells with a column for each order: the field's spectrum times |k|^order. Missing cells get the band's mean before and no
    value after; the grid is padded with 0 to powers of two. demean=True takes the mean off first, which avoids ringing."""
    rows_n, cols_n = padded(height), padded(width)
    mean = cells.groupBy("band").agg(F.avg("value").alias("_mean"))
    filled = cells.join(F.broadcast(mean), "band").withColumn("_f", F.coalesce("value", "_mean") - (F.col("_mean") if demean else F.lit(0.0)))
    filled = filled.select("band", "row", "col", "_f", F.expr(f"int(row div {BLOCK})").alias("block"))
    names = list(orders)

    def rows_forward(key, pdf: pd.DataFrame) -> pd.DataFrame:
        band, block = key
        grid = np.zeros((BLOCK, cols_n))
        grid[pdf["row"].to_numpy() - block * BLOCK, pdf["col"].to_numpy()] = pdf["_f"].to_numpy()
        spectrum = np.fft.fft(grid, axis=1)
        return _blocks(band, block, {"": spectrum}, cols_n)

    def columns(key, pdf: pd.DataFrame) -> pd.DataFrame:
        band, cblock = key
        size = min(BLOCK, cols_n - cblock * BLOCK)
        grid = np.zeros((max(rows_n, BLOCK), size), complex)
        for r in pdf.itertuples():
            grid[r.rblock * BLOCK : (r.rblock + 1) * BLOCK] = np.frombuffer(r.data, complex).reshape(BLOCK, size)
        spectrum = np.fft.fft(grid[:rows_n], axis=0)
        ky, kx = np.fft.fftfreq(rows_n, dx) * 2 * np.pi, np.fft.fftfreq(cols_n, dx)[cblock * BLOCK : cblock * BLOCK + size] * 2 * np.pi
        k = np.hypot(ky[:, None], kx[None, :])
        out = []
        for name, order in orders.items():
            back = np.fft.ifft(spectrum * k**order, axis=0)
            for rblock in range(-(-height // BLOCK)):
                part = np.zeros((BLOCK, size), complex)
                piece = back[rblock * BLOCK : (rblock + 1) * BLOCK]
                part[: len(piece)] = piece
                out.append((band, rblock, cblock, name, part.tobytes()))
        return pd.DataFrame(out, columns=["band", "rblock", "cblock", "name", "data"])

    def rows_back(key, pdf: pd.DataFrame) -> pd.DataFrame:
        band, rblock = key
        made = {}
        for name in names:
            grid = np.zeros((BLOCK, cols_n), complex)
            for r in pdf[pdf["name"] == name].itertuples():
                size = min(BLOCK, cols_n - r.cblock * BLOCK)
                grid[:, r.cblock * BLOCK : r.cblock * BLOCK + size] = np.frombuffer(r.data, complex).reshape(BLOCK, size)
            made[name] = np.fft.ifft(grid, axis=1).real
        count = min(BLOCK, height - rblock * BLOCK)
        out = {"band": band, "row": np.repeat(np.arange(count) + rblock * BLOCK, width).astype(np.int32), "col": np.tile(np.arange(width), count).astype(np.int32)}
        return pd.DataFrame(out | {n: g[:count, :width].ravel() for n, g in made.items()})

    kind = "band string, rblock int, cblock int, name string, data binary"
    first = filled.groupBy("band", "block").applyInPandas(rows_forward, kind)
    middle = first.groupBy("band", "cblock").applyInPandas(columns, kind)
    last = middle.groupBy("band", "rblock").applyInPandas(rows_back, "band string, row int, col int, " + ", ".join(f"`{n}` double" for n in names))
    masked = [F.when(F.col("value").isNotNull(), F.col(n)).alias(n) for n in names]
    return cells.join(last, ["band", "row", "col"]).select(*[cells[c] for c in cells.columns], *masked)


def _blocks(band, rblock, spectra: dict, cols_n: int) -> pd.DataFrame:
    out = [(band, rblock, c // BLOCK, name, np.ascontiguousarray(s[:, c : c + BLOCK]).tobytes()) for name, s in spectra.items() for c in range(0, cols_n, BLOCK)]
    return pd.DataFrame(out, columns=["band", "rblock", "cblock", "name", "data"])


def all_derivatives(cells: DataFrame, height: int, width: int, dx: float) -> DataFrame:
    """cells with fvd, svd, thg, as, tdr, thdr: one forward transform serves both vertical derivatives."""
    d = vertical_derivatives(cells, height, width, dx, {"fvd": 1, "svd": 2})
    d = horizontal_gradient(d, dx).withColumn("thg", total_gradient("gx", "gy"))
    d = d.withColumn("as", F.sqrt(F.col("thg") * F.col("thg") + F.col("fvd") * F.col("fvd") + F.lit(EPS_GRID)))
    d = d.withColumn("tdr", F.atan2(F.col("fvd"), F.col("thg") + F.lit(EPS_GRID))).drop("gx", "gy")
    return horizontal_gradient(d, dx, value="tdr").withColumn("thdr", total_gradient("gx", "gy")).drop("gx", "gy")
