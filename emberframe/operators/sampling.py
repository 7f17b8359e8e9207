"""Ranks, samples and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions import hash_int
from emberframe.operators.ordered import first_rows, percentiles, running_sums
from emberframe.sources.shared import stored


def pct_rank(df: DataFrame, col: str, part: list[str], out: str, fill: float = 0.5) -> DataFrame:
    """Rank among known values, ties averaged, over their number; `fill` where missing."""
    return pct_ranks(df, {out: col}, part, fill)


def pct_ranks(df: DataFrame, cols: dict[str, str], part: list[str], fill: float = 0.5) -> DataFrame:
    """`pct_rank` of several columns (out: column) in one pass. Counts per distinct value come first, and add up by ranges of
    values; columns of different types are compared as doubles."""
    one_type = len({df.schema[c].dataType for c in cols.values()}) == 1
    value = lambda c: F.col(c) if one_type else F.col(c).cast("double")
    known = df.select(*part, F.inline(F.array(*(F.struct(F.lit(o).alias("__of"), value(c).alias("__v")) for o, c in cols.items())))).filter("__v IS NOT NULL")
    s = running_sums(known.groupBy(*part, "__of", "__v").agg(F.count("*").alias("__n")), [*part, "__of"], ["__v"], {"__upto": "__n"})
    ranks = s.select(*part, "__of", "__v", ((F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2) / F.col("__upto_total")).alias("__rank"))
    for out, col in cols.items():
        own = ranks.filter(F.col("__of") == out).select(*part, "__v", F.col("__rank").alias(out))
        df = df.withColumn("__v", value(col)).join(own, [*part, "__v"], "left").withColumn(out, F.coalesce(out, F.lit(fill))).drop("__v")
    return df


def top_k(df: DataFrame, k: int, by: str, part: str, tie: str) -> DataFrame:
    """The k highest of each part, ties to the smaller `tie`."""
    w = Window.partitionBy(part).orderBy(F.col(by).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _uniform(key: str, seed: int) -> Column:
    return (hash_int(F.col(key), seed=seed) + 0.5) / float(1 << 32)


def _first_by_hash(df: DataFrame, want: dict[tuple, int], part: list[str], key: list[Column]) -> DataFrame:
    """The first rows of each part, by a cut through the counts of the order's values: nothing is sorted. A missing value comes
    first."""
    names = [f"__k{i}" for i in range(len(key))]
    numbers = [F.coalesce(k.cast("double"), F.lit(-1e300)) for k in key[:-1]]
    return first_rows(df.withColumns(dict(zip(names, [*numbers, key[-1]]))), part, names, want).select(*df.columns)


def balanced_sample(df: DataFrame, ratio: float = 4.0, seed: int = 42, caps: dict[str, int] | None = None, hard: tuple[str, str] | None = None, key: str = "sample_id", y: str = "y_fire", split: str = "split") -> DataFrame:
    """All positives of each split and max(ratio, 1) times as many negatives, as far as there are any.

    With `hard` = (column that should be high, column that should be low), negatives are drawn without replacement with
    weights from their ranks (Efraimidis-Spirakis keys). A cap keeps positives first, then a uniform share of the rest.
    Every draw depends on the key and the seed only.
    """
    y1 = F.col(y) == 1
    sizes = df.groupBy(split).agg(F.count_if(y1).alias("__pos"), F.count_if(~y1).alias("__neg"))
    target = F.least(F.col("__neg"), F.floor(F.greatest(F.col("__pos") * ratio, F.col("__pos").cast("double")))).cast("long")
    want = {(r[split],): r["__take"] for r in sizes.select(split, target.alias("__take")).collect()}  # a row a split
    neg = df.filter(~y1)
    u = _uniform(key, seed)
    if hard:
        high, low = hard
        neg = stored(pct_ranks(neg, {"__a": high, "__b": low}, [split]), "ranked-negatives")
        order = [-F.log(u) / F.greatest(F.col("__a") + 1.0 - F.col("__b"), F.lit(1e-6)), F.col(key)]
    else:
        order = [u, F.col(key)]
    drawn = _first_by_hash(neg, want, [split], order).select(*df.columns)
    out = df.filter(y1).unionByName(drawn)
    return cap_per_split(stored(out, "balanced"), caps, seed + 1, key, y, split) if caps else out  # a sample is small, its source isn't


def cap_per_split(df: DataFrame, caps: dict[str, int], seed: int = 43, key: str = "sample_id", y: str = "y_fire", split: str = "split") -> DataFrame:
    """At most caps[split] rows of each split, positives first, then by hash; splits without a cap stay whole."""
    order = [_uniform(key, seed) - 2 * F.coalesce(F.col(y), F.lit(9)), F.col(key)]  # a share below one each: the label decides first
    capped = F.col(split).isin(*caps)
    return df.filter(~capped | F.col(split).isNull()).unionByName(_first_by_hash(df.filter(capped), {(k,): n for k, n in caps.items()}, [split], order))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same whenever the keys and the seed are: an aligned sample of whole rows."""
    return _first_by_hash(df, {(): n}, [], [hash_int(F.col(key), seed=seed), F.col(key)])


def cap_negatives(df: DataFrame, n: int, key: str, y: str = "y_fire", seed: int = 42) -> DataFrame:
    """All positives and as many negatives as a budget of n rows leaves, the first by hash."""
    neg = df.filter(F.col(y) != 1)
    room = max(0, n - df.filter(F.col(y) == 1).count())
    return df.filter(F.col(y) == 1).unionByName(hash_sample(neg, room, key, seed))


def _day_ranks(df: DataFrame, day: str) -> DataFrame:
    """(day, rank from 1, number of days): one row a day."""
    days = df.select(day).distinct()
    return days.select(day, F.row_number().over(Window.orderBy(day)).alias("__r"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("__n"))


def split_by_quantile(df: DataFrame, day: str = "day", train: float = 0.70, val: float = 0.85) -> DataFrame:
    """By the dates at positions int(train*n) and int(val*n) of the sorted distinct dates, both inclusive; fewer than
    five dates raise an error."""
    r = _day_ranks(df, day)
    named = F.when(F.col("__n") < 5, F.raise_error(F.lit("fewer than five dates")).cast("string")).when(F.col("__r") <= F.floor(F.col("__n") * train), "train").when(F.col("__r") <= F.floor(F.col("__n") * val), "val").otherwise("test")
    return df.join(r.select(day, named.alias("split")), day)


def split_by_fraction(df: DataFrame, day: str = "day", train: float = 0.70, val: float = 0.15) -> DataFrame:
    """The first int(train*n) distinct dates, the next int(val*n), the rest."""
    r = _day_ranks(df, day)
    n1, n2 = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return df.join(r.select(day, F.when(F.col("__r") <= n1, "train").when(F.col("__r") <= n1 + n2, "val").otherwise("test").alias("split")), day)


def split_by_date(df: DataFrame, train_end: str, val_end: str, day: str = "label_date") -> DataFrame:
    d = F.col(day)
    return df.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").otherwise("test"))


def overlapping_dates(df: DataFrame, day: str = "day", split: str = "split") -> DataFrame:
    """Dates that more than one split holds; empty if there is no leak."""
    return df.groupBy(day).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def assert_disjoint(df: DataFrame, day: str = "day", split: str = "split") -> None:
    if not (bad := overlapping_dates(df, day, split)).isEmpty():
        raise ValueError(f"splits share dates, such as {bad.first()[day]}")


def split_years(df: DataFrame, day: str = "day", split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.sort_array(F.collect_set(F.year(day))).alias("years"))


def assert_split_years(df: DataFrame, want: dict[str, set[int]], day: str = "day", split: str = "split") -> None:
    got = {r[split]: set(r["years"]) for r in split_years(df, day, split).collect()}
    for name, years in want.items():
        if got.get(name, set()) != years:
            raise ValueError(f"split {name} has years {sorted(got.get(name, set()))}, expected {sorted(years)}")


def class_balance(df: DataFrame, day: str = "day", y: str = "y_fire", split: str = "split") -> DataFrame:
    """Rows, positives, rate, first and last year of each split, and the weight of a positive (at least 1)."""
    pos = F.count_if(F.col(y) == 1)
    return df.groupBy(split).agg(F.count("*").alias("n"), pos.alias("n_pos"), (pos / F.count("*")).alias("positive_rate"), F.min(F.year(day)).alias("first_year"), F.max(F.year(day)).alias("last_year"), F.greatest(F.coalesce(F.try_divide(F.count("*") - pos, pos), F.lit(1.0)), F.lit(1.0)).alias("pos_weight"))


def impute_median(df: DataFrame, cols: list[str], fit_on: str | None = "train", split: str = "split") -> DataFrame:
    """Medians of the training split (or of all rows with fit_on=None) in place of missing values."""
    fit = df if fit_on is None else df.filter(F.col(split) == fit_on)
    one = reduce(DataFrame.crossJoin, (percentiles(fit, [], c, {f"__{c}": 0.5}) for c in cols))
    return df.crossJoin(F.broadcast(one)).select(*(F.coalesce(c, F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in df.columns))  # one row


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=cols)


def zscore_fit(df: DataFrame, cols: list[str], floor: float = 1e-6, split: str | None = "split") -> DataFrame:
    """One row with mean and population deviation of each column on the training split; a deviation under `floor` is 1."""
    fit = df if split is None else df.filter(F.col(split) == "train")
    s = fit.agg(*(f(c).alias(f"{p}_{c}") for c in cols for f, p in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    return s.select(*(F.col(f"mean_{c}") for c in cols), *(F.when(F.col(f"std_{c}") < floor, 1.0).otherwise(F.col(f"std_{c}")).alias(f"std_{c}") for c in cols))


def zscore_apply(df: DataFrame, stats: DataFrame, cols: list[str], add: float = 0.0, least: float = 0.0) -> DataFrame:
    """(x - mean) / (deviation, at least `least`, plus `add`)."""
    z = {c: (F.col(c) - F.col(f"mean_{c}")) / (F.greatest(F.col(f"std_{c}"), F.lit(least)) + add) for c in cols}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)  # one row


def sequence_stats(df: DataFrame, col: str = "sequence") -> DataFrame:
    """(feature, mean, std) over all samples and steps of an array-of-arrays column."""
    steps = df.select(F.explode(col).alias("s")).select(F.posexplode("s").alias("feature", "x"))
    return steps.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))
