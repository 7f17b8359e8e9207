"""Hourly grids to daily cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions import celsius, millimetres, rel_humidity, soil_moisture_index, vpd, wind_dir_from, wind_dir_math, wind_speed

#: Variables of the hourly source that are averaged, fixed values.
MEANS = ("d2m", "sp", "u10", "v10", "swvl1", "swvl2", "cvh", "cvl", "lai_hv", "lai_lv", "blh")


def daily_weather(obs: DataFrame, cell: tuple[str, ...] = ("cell_id",), time: str = "time") -> DataFrame:
    """One row per cell and day: extremes and mean of temperature, means, gust maximum, rain sum in mm (0 if all hours
    are missing), vector-mean wind, humidity of the daily means, soil moisture. One shuffle, on (cell, day)."""
    day = obs.groupBy(*cell, F.to_date(time).alias("date")).agg(
        F.avg("t2m").alias("t2m_mean"), F.max("t2m").alias("t2m_max"), F.min("t2m").alias("t2m_min"),
        *(F.avg(c).alias(f"{c}_mean") for c in MEANS),
        F.max("i10fg").alias("i10fg_max"), millimetres(F.coalesce(F.sum("tp"), F.lit(0.0))).alias("tp_sum_mm"),
    )
    direction = F.radians(wind_dir_from(F.col("u10_mean"), F.col("v10_mean")))
    return day.withColumns({
        "wind_speed_mean": wind_speed(F.col("u10_mean"), F.col("v10_mean")), "wind_dir_sin": F.sin(direction), "wind_dir_cos": F.cos(direction),
        "rh_mean": rel_humidity(F.col("t2m_mean"), F.col("d2m_mean")), "soil_moisture_index": soil_moisture_index(F.col("swvl1_mean"), F.col("swvl2_mean")),
    })


def daily_weather_grid(obs: DataFrame, cell: tuple[str, ...] = ("cell_id",), time: str = "time") -> DataFrame:
    """The other flavour: °C, mathematical wind angle, vapour pressure deficit, highest boundary layer."""
    day = obs.groupBy(*cell, F.to_date(time).alias("date")).agg(
        celsius(F.max("t2m")).alias("t2m_max_C"), celsius(F.min("t2m")).alias("t2m_min_C"), celsius(F.avg("t2m")).alias("t2m_mean_C"), celsius(F.avg("d2m")).alias("d2m_mean_C"),
        F.avg("sp").alias("sp_mean"), F.avg("u10").alias("u"), F.avg("v10").alias("v"), F.max("i10fg").alias("wind_gust_max"),
        millimetres(F.coalesce(F.sum("tp"), F.lit(0.0))).alias("precip_sum_mm"), F.avg("swvl1").alias("soil_water_l1_mean"), F.avg("swvl2").alias("soil_water_l2_mean"),
        F.avg("cvh").alias("high_veg_cover"), F.avg("cvl").alias("low_veg_cover"), F.avg("lai_hv").alias("lai_high_veg"), F.avg("lai_lv").alias("lai_low_veg"),
        F.avg("blh").alias("blh_mean"), F.max("blh").alias("blh_max"),
    )
    angle = wind_dir_math(F.col("u"), F.col("v"))
    return day.withColumns({
        "wind_speed_mean": wind_speed(F.col("u"), F.col("v")), "wind_dir_sin": F.sin(angle), "wind_dir_cos": F.cos(angle), "vpd": vpd(F.col("t2m_mean_C"), F.col("d2m_mean_C")),
    }).drop("u", "v")


def rainfall_24h(obs: DataFrame, cell: str = "cell_id", time: str = "time", value: str = "tp", steps: int = 24, ties: tuple[str, ...] = ()) -> DataFrame:
    """Sum over the last `steps` rows of the cell; one value is enough."""
    w = Window.partitionBy(cell).orderBy(time, *ties).rowsBetween(1 - steps, 0)
    return obs.withColumn("rainfall_24h", F.sum(value).over(w))


def rolling_history(df: DataFrame, specs: dict[str, tuple[str, str]], n: int = 7, cell: str = "cell_id", day: str = "date", calendar: bool = False) -> DataFrame:
    """For each name in specs, (column, aggregate) over the last n rows of the cell, or days if `calendar`; null unless
    all n are there and known. All of them share one sort."""
    by = Window.partitionBy(cell)
    w = by.orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(1 - n, 0) if calendar else by.orderBy(day).rowsBetween(1 - n, 0)
    return df.withColumns({name: F.when(F.count(c).over(w) == n, getattr(F, how)(c).over(w)) for name, (c, how) in specs.items()})


def carry_forward(df: DataFrame, key: str, order: str, col: str, out: str | None = None) -> DataFrame:
    """The day's own value, else the last one seen."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or col, F.last(col, ignorenulls=True).over(w))


def concat_complete_years(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows of years that have all twelve months."""
    years = df.select(F.year(time).alias("__y"), F.month(time).alias("__m")).distinct().groupBy("__y").count().filter("count = 12")
    return df.withColumn("__y", F.year(time)).join(F.broadcast(years.select("__y")), "__y", "left_semi").drop("__y")  # one row a year
