"""Weather and terrain formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rel_humidity(t: Column, d: Column) -> Column:
    """Percent, from temperature and dew point in kelvin (Magnus), kept within 0 to 100. From daily means or hourly
    values alike: the caller picks the order of averaging."""

    def vapour(c: Column) -> Column:
        return F.lit(6.112) * F.exp(F.lit(17.67) * c / (c + 243.5))

    pct = F.lit(100.0) * vapour(d - 273.15) / vapour(t - 273.15)
    return F.when(pct > 100.0, 100.0).when(pct < 0.0, 0.0).otherwise(pct)  # least and greatest would turn null into a bound


def vpd(t: Column, d: Column) -> Column:
    """Vapour pressure deficit in kPa, from temperature and dew point in °C (Tetens)."""

    def vapour(c: Column) -> Column:
        return F.lit(0.6108) * F.exp(F.lit(17.27) * c / (c + 237.3))

    return vapour(t) - vapour(d)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_dir_from(u: Column, v: Column) -> Column:
    """Degrees, by the meteorological convention."""
    return F.degrees(F.atan2(u, v)) + 180.0


def wind_dir_math(u: Column, v: Column) -> Column:
    """Radians, counter-clockwise from east."""
    return F.atan2(v, u)


def soil_moisture_index(upper: Column, lower: Column) -> Column:
    return (upper + lower) / 2.0


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def millimetres(metres: Column) -> Column:
    return metres * 1000.0


def thermal_celsius(dn: Column) -> Column:
    """Thermal band numbers to °C."""
    return dn * 0.00341802 + 149.0 - 273.15


def aspect_sin(aspect: Column) -> Column:
    return F.sin(F.radians(aspect))


def aspect_cos(aspect: Column) -> Column:
    return F.cos(F.radians(aspect))


def orographic_index(elevation: Column, slope: Column) -> Column:
    return elevation * slope


def ridge_flag(tpi: Column, threshold: float) -> Column:
    return (tpi > threshold).cast("int")


def wind_exposure(slope: Column, aspect: Column) -> Column:
    return slope * aspect_sin(aspect)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def confidence_pct(p: Column) -> Column:
    return p * 100.0


def pixel_metres(degrees: Column | float, latitude: Column) -> Column:
    """East-west size of a pixel in metres."""
    return F.lit(111320.0) * degrees * F.cos(F.radians(latitude))
