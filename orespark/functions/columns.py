"""Scalar functions as Column expressions. Missing is NULL everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BAND_CATALOGUE, EPS_TABLE, NODATA


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nodata_to_null(value, nodata: float = NODATA) -> Column:
    v = col(value).cast("double")
    return F.when((v != F.lit(nodata)) & ~F.isnan(v), v)


def null_to_nodata(value, nodata: float = NODATA) -> Column:
    return F.coalesce(col(value), F.lit(nodata))


def ratio(a, b, eps: float = EPS_TABLE) -> Column:
    """a / b with the denominator floored; NULLs count as 0."""
    return F.coalesce(col(a), F.lit(0.0)) / F.greatest(F.coalesce(col(b), F.lit(0.0)), F.lit(eps))


def log10_clip(x, eps: float = EPS_TABLE) -> Column:
    return F.when(col(x).isNotNull(), F.log10(F.greatest(col(x), F.lit(eps))))


def gradient_magnitude(g, fvd, eps: float = EPS_TABLE) -> Column:
    return F.sqrt(col(g) * col(g) + col(fvd) * col(fvd) + F.lit(eps))


def analytic_signal_1d(g, fvd, eps: float = EPS_TABLE) -> Column:
    return F.sqrt(F.lit(2.0) * col(g) * col(g) + col(fvd) * col(fvd) + F.lit(eps))


def clip(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def strip(x, lo, hi, n: int) -> Column:
    """Which of n equal strips between lo and hi; all in the first if there is no extent."""
    lo, hi = col(lo), col(hi)
    return F.when(hi > lo, clip(F.floor((col(x) - lo) * n / (hi - lo)).cast("int"), 0, n - 1)).otherwise(0)


def band_name(path) -> Column:
    """The canonical band of a raster file: its stem without a projection's suffix, through the catalogue."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[A-Za-z]+$", ""), "_epsg2953$", "")
    known = F.create_map(*[F.lit(x) for pair in BAND_CATALOGUE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, stem), stem)


def legend_class(p) -> Column:
    return F.when(col(p) > 0.9, "high").when(col(p) > 0.7, "moderate").when(col(p) > 0.5, "low").otherwise("background")


def wkt_point(x, y) -> Column:
    return F.format_string("POINT (%s %s)", col(x).cast("string"), col(y).cast("string"))


def wkt_x(wkt) -> Column:
    return F.regexp_extract(col(wkt), r"POINT \(([-0-9.eE]+) ([-0-9.eE]+)\)", 1).try_cast("double")


def wkt_y(wkt) -> Column:
    return F.regexp_extract(col(wkt), r"POINT \(([-0-9.eE]+) ([-0-9.eE]+)\)", 2).try_cast("double")


def buffer_wkt(x, y, radius: float, corners: int = 32) -> Column:
    """The circle around a point as a polygon with so many corners."""
    angle = lambda i: F.lit(2 * 3.141592653589793) * (i % corners) / corners
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.concat_ws(" ", F.round(col(x) + radius * F.cos(angle(i)), 3), F.round(col(y) + radius * F.sin(angle(i)), 3)))
    return F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))"))


def with_missing(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """df with the columns that it lacks as NULLs."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def available(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """The columns of the list that df has, and those it lacks, in the list's order."""
    return [c for c in columns if c in df.columns], [c for c in columns if c not in df.columns]


def clean_names(df: DataFrame) -> DataFrame:
    """df with its columns' names in lower case, without white space around them; two that become one are an error."""
    names = [c.lower().strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns share a name: {sorted(c for c in set(names) if names.count(c) > 1)}")
    return df.toDF(*names)
