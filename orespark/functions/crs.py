"""Oblique stereographic projection (EPSG method 9809) as Column expressions, with the parameters of EPSG:2953."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

#: EPSG:2953 on GRS80 (fixed values).
A, FLATTENING, LAT0, LON0, K0, FE, FN = 6378137.0, 1 / 298.257222101, math.radians(46.5), math.radians(-66.5), 0.999912, 2500000.0, 7500000.0
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
_s0 = math.sin(LAT0)
RADIUS = math.sqrt(A * (1 - E2) / (1 - E2 * _s0**2) ** 1.5 * A / math.sqrt(1 - E2 * _s0**2))
N = math.sqrt(1 + E2 * math.cos(LAT0) ** 4 / (1 - E2))
_w1 = ((1 + _s0) / (1 - _s0) * ((1 - E * _s0) / (1 + E * _s0)) ** E) ** N
_x0 = (_w1 - 1) / (_w1 + 1)
C = (N + _s0) * (1 - _x0) / ((N - _s0) * (1 + _x0))
CHI0 = math.asin((C * _w1 - 1) / (C * _w1 + 1))
SCALE = 2 * RADIUS * K0


def to_xy(lon, lat) -> tuple[Column, Column]:
    """Degrees to metres."""
    s, d = F.sin(F.radians(col(lat))), N * (F.radians(col(lon)) - LON0)
    w = C * F.pow((1 + s) / (1 - s) * F.pow((1 - E * s) / (1 + E * s), F.lit(E)), F.lit(N))
    sin_chi = (w - 1) / (w + 1)
    cos_chi = F.sqrt(1 - sin_chi * sin_chi)
    b = 1 + sin_chi * math.sin(CHI0) + cos_chi * math.cos(CHI0) * F.cos(d)
    return FE + SCALE * cos_chi * F.sin(d) / b, FN + SCALE * (sin_chi * math.cos(CHI0) - cos_chi * math.sin(CHI0) * F.cos(d)) / b


def to_lonlat(x, y) -> tuple[Column, Column]:
    """Metres to degrees."""
    e, n = col(x) - FE, col(y) - FN
    g = SCALE * math.tan(math.pi / 4 - CHI0 / 2)
    h = 2 * SCALE * math.tan(CHI0) + g
    i = F.atan(e / (h + n))
    j = F.atan(e / (g - n)) - i
    chi = CHI0 + 2 * F.atan((n - e * F.tan(j / 2)) / SCALE)
    lon = (j + 2 * i) / N + LON0
    psi = 0.5 * F.log((1 + F.sin(chi)) / (C * (1 - F.sin(chi)))) / N
    lat = 2 * F.atan(F.exp(psi)) - math.pi / 2

    def closer(phi, _):
        s = F.sin(phi)
        here = F.log(F.tan(phi / 2 + math.pi / 4) * F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2)))
        return phi - (here - psi) * F.cos(phi) * (1 - E2 * s * s) / (1 - E2)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(4)), lat, closer)
    return F.degrees(lon), F.degrees(lat)
