"""Statistics, coverage, audits and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.ordered import percentiles

PERCENTS = (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))


def layer_stats(pix: DataFrame, layer: str = "layer", value: str = "value") -> DataFrame:
    """Count, extremes, percentiles (linear), mean, population deviation and bias-corrected skew of each layer."""
    n = F.count(value)
    s = pix.groupBy(layer).agg(n.alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("__skew"))
    c = F.col("count").cast("double")
    skew = F.when(c > 2, F.col("__skew") * F.sqrt(c * (c - 1)) / (c - 2))
    q = percentiles(pix, [layer], value, dict(PERCENTS)).withColumnRenamed(layer, "__layer")
    return s.join(q, F.col(layer).eqNullSafe(F.col("__layer")), "left").select(layer, "count", "min", *(name for name, _ in PERCENTS), "max", "mean", "std", skew.alias("skew"))


def corr_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, strongest first, from one pass over aligned rows."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs))))).orderBy(F.abs("r").desc(), "a", "b")


def missing_report(df: DataFrame, cols: list[str], warn: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """(variable, missing_fraction, warn) and the number of steps."""
    one = df.groupBy(*(by or [])).agg(F.count("*").alias("steps"), *(F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in cols))
    rows = F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"m_{c}").alias("missing_fraction"), (F.col(f"m_{c}") > warn).alias("warn")) for c in cols)))
    return one.select(*(by or []), "steps", rows)


def coverage(df: DataFrame, time: str = "time", lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.count_distinct(lat, lon).alias("n_points"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count_distinct(time).alias("n_times"), F.array_join(F.sort_array(F.collect_set(F.hour(time))), ",").alias("hours"))


def raster_qa(pix: DataFrame, aoi: dict, tol: float = 0.01, layer: str = "layer", value: str = "value") -> DataFrame:
    """Per layer: does its extent cover the area, does it hold any value, its statistics, and whether it passes.
    pix: layer, west, south, east, north of the pixel, value."""
    s = pix.groupBy(layer).agg(F.min("west").alias("w"), F.min("south").alias("s"), F.max("east").alias("e"), F.max("north").alias("n"), F.count(value).alias("n_valid"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    lon = (F.col("w") <= aoi["west"] + tol) & (F.col("e") >= aoi["east"] - tol)
    lat = (F.col("s") <= aoi["south"] + tol) & (F.col("n") >= aoi["north"] - tol)
    return s.select(layer, lon.alias("lon_ok"), lat.alias("lat_ok"), "n_valid", "min", "max", "mean", "std", (lon & lat & (F.col("n_valid") > 0)).alias("passed"))


def validate_tiles(expected: DataFrame, meta: DataFrame, degrees: float, rtol: float = 0.1, key: str = "tile") -> DataFrame:
    """(tile, status, warnings): missing, invalid (no projection, no bands, empty) or valid; warnings: pixel size off."""
    j = expected.join(meta.withColumn("__there", F.lit(True)), key, "left")
    bad = F.col("crs").isNull() | (F.coalesce("bands", F.lit(0)) < 1) | (F.coalesce("n_pixels", F.lit(0)) == 0)
    status = F.when(F.col("__there").isNull(), "missing").when(bad, "invalid").otherwise("valid")
    off = (status == "valid") & (F.abs(F.col("pixel_size") - degrees) > rtol * degrees + 1e-8)
    return j.select(key, status.alias("status"), F.when(off, "pixel size").alias("warning"))


def timeline(index: DataFrame, by: str = "source", year: str = "year") -> DataFrame:
    return index.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set(year)), ",").alias("years"), F.count("*").alias("n"))


def sparse_months(windows: DataFrame, least: int = 6, start: str = "window_start") -> DataFrame:
    """Months with fewer distinct windows than `least`."""
    return windows.select(F.year(start).alias("year"), F.month(start).alias("month"), start).distinct().groupBy("year", "month").agg(F.count("*").alias("n_windows")).filter(F.col("n_windows") < least)


def dataset_metadata(df: DataFrame, features: list[str], split: str = "split", y: str = "y_fire", day: str = "label_date") -> DataFrame:
    """Rows, positives and years of each split, with the feature list."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"), F.array_join(F.sort_array(F.collect_set(F.year(day))), ",").alias("years")).withColumn("features", F.lit(",".join(features)))


def merge_members(a: DataFrame, b: DataFrame, keys: list[str], how: str = "exact") -> DataFrame:
    """Instant and accumulated fields on their common keys. 'exact' raises an error if a key is on one side only;
    'outer' keeps it with nulls."""
    left, right = a.withColumn("__l", F.lit(1)), b.withColumn("__r", F.lit(1))
    j = left.join(right, keys, "full_outer")
    if how == "exact":
        lone = F.col("__l").isNull() | F.col("__r").isNull()
        j = j.filter(F.when(lone, F.raise_error(F.lit("members have different times or points")).cast("boolean")).otherwise(True))
    return j.drop("__l", "__r")


def reconcile_status(progress: DataFrame, tasks: DataFrame, order: list[Column], key: str = "task_key", done: tuple[str, ...] = ("COMPLETED",), failed: tuple[str, ...] = ("FAILED", "CANCELLED")) -> DataFrame:
    """`submitted` entries become done or failed by their most recent task (first by `order`); others stay."""
    latest = tasks.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").select(key, "state")
    open_ = F.col("status") == "submitted"
    new = F.when(open_ & F.col("state").isin(*done), "done").when(open_ & F.col("state").isin(*failed), "failed").otherwise(F.col("status"))
    return progress.join(latest, key, "left").withColumn("status", new).drop("state")


def status_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count("*").alias("n"))
