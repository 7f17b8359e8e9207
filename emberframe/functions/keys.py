"""String keys, dates and grid arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap(x: Column, res: float = 0.25) -> Column:
    """To the grid's step, halves to even."""
    return F.rint(x / res) * res


def cell_id(lat: Column, lon: Column) -> Column:
    """Of coordinates on the grid; snap others first."""
    return F.format_string("%.2f_%.2f", lat, lon)


def sample_id(cell: Column, day: Column) -> Column:
    return F.concat(cell.cast("string"), F.lit("_"), F.date_format(day, "yyyyMMdd"))


def region(cell: Column, lat: Column, lon: Column) -> Column:
    return F.format_string("cell:%s (%.2f,%.2f)", cell.cast("string"), lat, lon)


def day_label(day: Column) -> Column:
    return F.date_format(day, "yyyy_MM_dd")


def month_number(day: Column) -> Column:
    """Months since year 0, so that months can be compared and subtracted."""
    return F.year(day) * 12 + F.month(day)


def pixel_centre(index: Column, edge: float, span: float, n: int) -> Column:
    return F.lit(edge) + (index + 0.5) * (span / n)


def pixel_index(coordinate: Column, edge: float, span: float, n: int) -> Column:
    return F.floor((coordinate - edge) * (n / span)).cast("int")


def hash_int(*columns: Column, seed: int = 42) -> Column:
    """A 32-bit number that any engine gets from the md5 of the values and the seed."""
    text = F.concat_ws("|", *(c.cast("string") for c in columns), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
