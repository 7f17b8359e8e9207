"""Joins over days, intervals and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions import month_number


def attach_windows(samples: DataFrame, win: DataFrame, cols: list[str], max_lag: int | None = None, prefix: str = "", causal: bool = False, cell: str = "cell_id", day: str = "day") -> DataFrame:
    """Values of the window that covers the day (the last by window_end), else of the last one that ended before it.

    Adds `available` and `lag_days` (day less window_end, negative if the covering window ends later). A lag over
    `max_lag` blanks the values but stays. With `causal`, a window counts only once it has ended. Covering windows are
    spread over their days and matched by equal keys; earlier ones come by one ordered window per cell: no nested loop.
    """
    want = samples.select(F.col(cell).alias("__cell"), F.col(day).alias("__day")).distinct()
    value = F.struct(F.col("window_end").alias("e"), F.col("window_start").alias("s"), *(F.col(c) for c in cols)).alias("v")
    panel = win.filter(F.col(cell).isNotNull()).select(F.col(cell).alias("__cell"), "window_start", "window_end", value)
    last = panel.groupBy("__cell", F.col("window_end").alias("__day")).agg(F.max_by("v", F.struct("window_end", "window_start")).alias("v"))
    events = last.select("__cell", "__day", "v", F.lit(0).alias("__kind")).unionByName(want.select("__cell", "__day", F.lit(None).cast(last.schema["v"].dataType).alias("v"), F.lit(1).alias("__kind")))
    order = Window.partitionBy("__cell").orderBy("__day", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("prior", F.last("v", ignorenulls=True).over(order)).filter("__kind = 1").select("__cell", "__day", "prior")
    if not causal:
        spread = panel.select("__cell", F.explode(F.sequence("window_start", "window_end")).alias("__day"), "v", "window_end", "window_start")
        cover = spread.groupBy("__cell", "__day").agg(F.max_by("v", F.struct("window_end", "window_start")).alias("cover"))
        found = found.join(cover, ["__cell", "__day"], "left").withColumn("prior", F.coalesce("cover", "prior"))
    lag = F.datediff("__day", F.col("prior.e"))
    fresh = F.col("prior").isNotNull() if max_lag is None else F.col("prior").isNotNull() & (lag <= max_lag)
    right = found.select(F.col("__cell").alias(cell), F.col("__day").alias(day), *(F.when(fresh, F.col(f"prior.{c}")).alias(prefix + c) for c in cols), F.coalesce(fresh, F.lit(False)).cast("int").alias(f"{prefix}available"), lag.alias(f"{prefix}lag_days"))
    out = samples.join(right, [cell, day], "left")
    return out.withColumn(f"{prefix}available", F.coalesce(f"{prefix}available", F.lit(0)))


def resolve_month(df: DataFrame, months: DataFrame, day: str = "day", lag: int = 0) -> DataFrame:
    """The latest available (year, month) not after the day's month less `lag`; rows without one go.

    The available months are few: one row each, so they are joined by broadcast as intervals of month numbers spread
    over the months that they answer for."""
    m = months.select((F.col("year") * 12 + F.col("month")).alias("m")).distinct()
    after = F.lead("m").over(Window.orderBy("m"))
    bounds = df.agg(F.max(month_number(F.col(day))).alias("top"))
    spans = m.withColumn("next", after).crossJoin(F.broadcast(bounds))  # one row
    answers = spans.select("m", F.explode(F.sequence("m", F.greatest("m", F.coalesce(F.col("next") - 1, F.col("top"))))).alias("__m"))
    out = df.withColumn("__m", month_number(F.col(day)) - lag).join(answers, "__m")
    return out.select(*df.columns, F.floor((F.col("m") - 1) / 12).cast("int").alias("used_year"), (F.pmod(F.col("m") - 1, F.lit(12)) + 1).cast("int").alias("used_month"))


def asof_latest(left: DataFrame, right: DataFrame, day: str, right_day: str, cols: list[str], by: str | None = None, out: str = "asof_day") -> DataFrame:
    """Values of the latest right row at or before the left row's day (ties: the greatest values); null if none."""
    key = F.col(by) if by else F.lit(0)
    value = F.struct(F.col(right_day).alias(out), *(F.col(c) for c in cols)).alias("v")
    marks = right.select(key.alias("__k"), F.col(right_day).alias("__d"), value).groupBy("__k", "__d").agg(F.max("v").alias("v"))
    want = left.select(key.alias("__k"), F.col(day).alias("__d")).distinct()
    events = marks.withColumn("__kind", F.lit(0)).unionByName(want.select("__k", "__d", F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.lit(1).alias("__kind")))
    w = Window.partitionBy("__k").orderBy("__d", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("__kind = 1").select("__k", F.col("__d").alias(day), "v")
    return left.withColumn("__k", key).join(found, ["__k", day], "left").select(*left.columns, "v.*")


def prev_day(df: DataFrame, keys: list[str], day: str, col: str, out: str) -> DataFrame:
    """The same key's value on the calendar day before; 0 if there is no such row."""
    before = df.groupBy(*keys, F.date_add(day, 1).alias(day)).agg(F.max(col).alias(out))
    return df.join(before, [*keys, day], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def active_per_day(iv: DataFrame, start: str = "s", end: str = "e", out: str = "reference_active_count") -> DataFrame:
    """Intervals that are open on each day; a missing end, or one before the start, counts as the start. Each interval
    gives two marks, not a row a day; a running sum over the days does the rest."""
    stop = F.greatest(F.coalesce(end, start), F.col(start))
    marks = iv.filter(F.col(start).isNotNull()).select(F.inline(F.array(F.struct(F.col(start).alias("date"), F.lit(1).alias("n")), F.struct(F.date_add(stop, 1).alias("date"), F.lit(-1).alias("n")))))
    days = marks.groupBy("date").agg(F.sum("n").alias("n"))  # one row a day from here on
    w = Window.orderBy("date")
    spans = days.select("date", F.sum("n").over(w).alias(out), F.lead("date").over(w).alias("next")).filter(F.col(out) > 0)
    return spans.select(F.explode(F.sequence("date", F.date_sub("next", 1))).alias("date"), out)


def calendar(spark, first: Column | str, last: Column | str, source: DataFrame | None = None) -> DataFrame:
    """Every day from first to last; both may be aggregates over `source`."""
    if source is not None:
        return source.agg(F.expr(first).alias("a") if isinstance(first, str) else first.alias("a"), F.expr(last).alias("b") if isinstance(last, str) else last.alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def on_calendar(days: DataFrame, counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """`days` with each count of `names` (0 where missing) and a 0/1 flag under its second name."""
    out = days.join(counts, "date", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).withColumns({flag: (F.coalesce(c, F.lit(0)) > 0).cast("int") for c, flag in names.items()})


def attach_reference(daily: DataFrame, days: DataFrame, target: str, day: str = "date") -> DataFrame:
    return daily.join(days, day, "left").filter(F.col(target).isNotNull())


def map_values(df: DataFrame, values: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(values.dropDuplicates([key]), key, "left")


def with_full_history(days: DataFrame, n: int = 7, day: str = "date") -> DataFrame:
    """Days whose n previous calendar days are all there."""
    one = days.select(day).distinct()
    near = one.select(F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, n))).alias(day)).groupBy(day).count().filter(F.col("count") == n)
    return one.join(near, day, "left_semi")


def gaps(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not there."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def sequences(samples: DataFrame, daily: DataFrame, static: DataFrame, day_cols: list[str], static_cols: list[str], n: int = 7, cell: str = "cell_id", day: str = "day") -> DataFrame:
    """For each sample, n rows of day_cols then static_cols, for the n calendar days up to its day. Dropped unless every
    day is there with all its values and the cell has a static row; missing static values pass."""
    steps = samples.select("sample_id", cell, day, F.posexplode(F.sequence(F.date_sub(day, n - 1), F.col(day))).alias("t", "__d"))
    full = daily.dropna(subset=day_cols).select(cell, F.col(day).alias("__d"), F.array(*(F.col(c).cast("float") for c in day_cols)).alias("__x"))
    fixed = static.dropDuplicates([cell]).select(cell, F.array(*(F.col(c).cast("float") for c in static_cols)).alias("__s"))
    got = steps.join(full, [cell, "__d"]).groupBy("sample_id", cell, day).agg(F.sort_array(F.collect_list(F.struct("t", "__x"))).alias("__seq")).filter(F.size("__seq") == n)
    return got.join(fixed, cell).select("sample_id", cell, day, F.transform("__seq", lambda s: F.concat(s["__x"], F.col("__s"))).alias("sequence"))


def back_windows(spark, first: str, last: str, step: int) -> DataFrame:
    """Tumbling windows from the last day backward, the earliest cut at `first`; the label is the window's last day, the
    end the day after it."""
    ends = spark.range(1).select(F.explode(F.sequence(F.lit(last).cast("date"), F.lit(first).cast("date"), F.expr(f"interval -{step} days"))).alias("d"))
    return ends.select(F.greatest(F.date_sub("d", step - 1), F.lit(first).cast("date")).alias("window_start"), F.date_add("d", 1).alias("window_end"), F.date_format("d", "yyyy_MM_dd").alias("label"))


def back_window_of(day: Column, last: str, step: int) -> Column:
    """Last day of the backward window that holds `day`."""
    end = F.lit(last).cast("date")
    return F.date_sub(end, (F.floor(F.datediff(end, day) / step) * step).cast("int"))


def lookback_windows(spark, first: str, last: str, step: int = 5, length: int = 10) -> DataFrame:
    """Windows of `length` days before every step-th day from the last one down to `first`; end exclusive."""
    ends = spark.range(1).select(F.explode(F.sequence(F.lit(last).cast("date"), F.lit(first).cast("date"), F.expr(f"interval -{step} days"))).alias("window_end"))
    return ends.select(F.date_sub("window_end", length).alias("window_start"), "window_end", F.date_format("window_end", "yyyy_MM_dd").alias("label"))


def with_lookback(df: DataFrame, day: str, last: str, first: str, step: int = 5, length: int = 10) -> DataFrame:
    """Each row once for every look-back window that holds its day, by arithmetic on the day, without a join."""
    end = F.lit(last).cast("date")
    ahead = F.datediff(end, day)  # a window ends after the day, at most `length` days later
    ends = F.transform(F.sequence(F.ceil((ahead - length) / step), F.ceil(ahead / step) - 1), lambda k: F.date_sub(end, (k * step).cast("int")))
    return df.withColumn("window_end", F.explode(ends)).filter(F.col("window_end").between(F.lit(first).cast("date"), end))
