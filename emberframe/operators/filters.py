"""Row filters and cleaning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASON = (5, 6, 7, 8, 9, 10, 11)


def in_bbox(df: DataFrame, west: float, south: float, east: float, north: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Closed on all sides."""
    return df.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def in_season(df: DataFrame, col: str, months: tuple[int, ...] = SEASON) -> DataFrame:
    return df.filter(F.month(col).isin(*months))


def in_dates(df: DataFrame, col: str, first: date, last: date) -> DataFrame:
    return df.filter(F.col(col).between(F.lit(first), F.lit(last)))


def null_nodata(df: DataFrame, cols: list[str], nodata: float = -32768.0) -> DataFrame:
    """NaN and the nodata value become null, so that they never reach a comparison or an aggregate."""
    return df.withColumns({c: F.when(~(F.isnan(c) | (F.col(c) == nodata)), F.col(c)) for c in cols})


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def cloud_below(df: DataFrame, pct: float = 40.0, col: str = "cloud_pct") -> DataFrame:
    return df.filter(F.col(col) < pct)


def hot_cell(conf: Column, threshold: float = 30.0) -> Column:
    """The cell rule: confidence is known and high enough."""
    return F.coalesce(conf >= threshold, F.lit(False))


def hot_pixel(flag: Column, conf: Column, threshold: float = 30.0) -> Column:
    """The pixel rule: flagged, unless confidence is known to be too low."""
    return F.when(conf < threshold, 0).when(flag.isNotNull(), 1).otherwise(0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()
