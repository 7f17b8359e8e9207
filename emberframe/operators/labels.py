"""Hotspots to labels, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.filters import hot_cell


def cell_labels(hot: DataFrame, threshold: float = 30.0, day: str = "day", cell: str = "cell_id", conf: str = "conf") -> DataFrame:
    """One row per day and cell with a hotspot: pixels, highest confidence, y_fire = 1."""
    kept = hot.filter(hot_cell(F.col(conf), threshold))
    return kept.groupBy(day, cell).agg(F.count("*").cast("int").alias("firms_n_pixels"), F.max(conf).alias("firms_max_confidence"), F.lit(1).cast("tinyint").alias("y_fire"))


def attach_label(df: DataFrame, labels: DataFrame, lead: int = 1, day: str = "date", cell: str = "cell_id", label_day: str = "day") -> DataFrame:
    """Label of `lead` days later; no label row means no fire."""
    right = labels.select(F.col(label_day).alias("label_date"), cell, "firms_n_pixels", "firms_max_confidence", "y_fire")
    out = df.withColumn("label_date", F.date_add(day, lead)).join(right, ["label_date", cell], "left")
    return out.withColumns({"y_fire": F.coalesce("y_fire", F.lit(0)).cast("tinyint"), "firms_n_pixels": F.coalesce("firms_n_pixels", F.lit(0)).cast("int")})


def labels_with_coverage(samples: DataFrame, days: DataFrame, day: str = "label_date", y: str = "y_fire") -> DataFrame:
    """The label only where the day has a hotspot source; elsewhere it is unknown, not negative."""
    known = days.select(F.col(days.columns[0]).alias(day)).distinct().withColumn("__known", F.lit(True))
    return samples.join(known, day, "left").withColumn(y, F.when(F.col("__known"), F.col(y))).drop("__known")


def daily_summary(pix: DataFrame, day: str = "day", conf: str = "conf", t21: str = "t21", flag: str = "flag", all_pixels: bool = True) -> DataFrame:
    """Valid and positive pixels, share, and statistics of both bands. The share is of all pixels of the day, or of the
    flagged ones if `all_pixels` is false."""

    def stats(c: str, name: str) -> list[Column]:
        return [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]

    out = pix.groupBy(day).agg(F.count(flag).alias("n_valid_pixels"), F.count_if(F.col(flag) > 0).alias("n_positive_pixels"), F.count("*").alias("n_pixels"), *stats(conf, "confidence"), *stats(t21, "t21"))
    base = F.col("n_pixels" if all_pixels else "n_valid_pixels")
    return out.withColumns({"positive_fraction": F.try_divide(F.col("n_positive_pixels"), base), "has_fire": (F.col("n_positive_pixels") > 0).cast("int")}).drop("n_pixels")


CONF_STEPS, T21_STEPS, BOTH = (30, 50, 60, 70, 80), (325, 350, 375), ((60, 325), (70, 350))


def daily_threshold_features(pix: DataFrame, day: str = "day", conf: str = "conf", t21: str = "t21", flag: str = "flag") -> DataFrame:
    """Highest, mean and 90th percentile of both bands over flagged pixels, and counts over thresholds; 0 without fire."""
    c, t, hot = F.col(conf), F.col(t21), F.coalesce(F.col(flag) > 0, F.lit(False))
    on = lambda x: F.when(hot, x)
    values = [(f"{n}_{a}", f(on(x))) for n, x in (("conf", c), ("t21", t)) for a, f in (("max", F.max), ("mean", F.avg), ("p90", lambda v: F.percentile(v, 0.9)))]
    counts = [(f"n_conf_ge_{s}", c >= s) for s in CONF_STEPS] + [(f"n_t21_ge_{s}", t >= s) for s in T21_STEPS] + [(f"n_both_conf{a}_t21{b}", (c >= a) & (t >= b)) for a, b in BOTH]
    return pix.groupBy(day).agg(
        F.count("*").alias("n_valid_pixels"), F.count_if(hot).alias("n_fire_pixels_label"),
        *(F.coalesce(v, F.lit(0.0)).alias(n) for n, v in values), *(F.count_if(hot & x).alias(n) for n, x in counts),
    )


def period_summary(daily: DataFrame, day: str = "day") -> DataFrame:
    """Days, positive pixels and mean share by (year, month) and by year (month null), in one pass."""
    d = daily.select(F.year(day).alias("year"), F.month(day).alias("month"), "n_positive_pixels", "positive_fraction")
    return d.groupingSets([[F.col("year"), F.col("month")], [F.col("year")]], F.col("year"), F.col("month")).agg(F.count("*").alias("days"), F.sum("n_positive_pixels").alias("total_positive_pixels"), F.avg("positive_fraction").alias("mean_positive_fraction"))


def fire_frequency(pix: DataFrame, keys: tuple[str, ...] = ("row", "col"), flag: str = "flag") -> DataFrame:
    return pix.groupBy(*keys).agg(F.count_if(F.col(flag) > 0).alias("days_on_fire"))


def top_days(daily: DataFrame, n: int = 30, by: str = "n_positive_pixels", day: str = "day") -> DataFrame:
    return daily.orderBy(F.col(by).desc(), day).limit(n)


def label_separation(df: DataFrame, cols: list[str], y: str = "y_fire") -> DataFrame:
    """For each column, its mean with and without fire, the difference, and its correlation with the label."""
    fire = F.col(y) == 1
    aggs = [x for c in cols for x in (F.avg(F.when(fire, F.col(c))).alias(f"f_{c}"), F.avg(F.when(~fire, F.col(c))).alias(f"n_{c}"), F.corr(F.col(c), F.col(y).cast("double")).alias(f"r_{c}"))]
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"f_{c}").alias("mean_fire"), F.col(f"n_{c}").alias("mean_no_fire"), (F.col(f"f_{c}") - F.col(f"n_{c}")).alias("difference"), F.col(f"r_{c}").alias("correlation")) for c in cols))
    return df.agg(*aggs).select(F.inline(rows))
