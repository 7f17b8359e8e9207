"""Running sums, ranks and exact percentiles over an order, without one task for a whole group.

Rows are dealt by ranges of (group, order) and stored with the number of their range. Sums within a range, plus the sums
of the ranges before it (one row a range and group), give the sums over the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.sources.shared import stored


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, (left[k].eqNullSafe(right[k]) for k in keys))


def running_sums(df: DataFrame, part: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each `out: column` of `sums`, the column's sum over the rows of `part` up to this one by `order` (out)
    and over all rows of `part` (out_total). `order` should have no ties."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *part, *order).withColumn("__range", F.spark_partition_id()), "ordered")
    keys = [*part, "__range"]
    ranges = dealt.groupBy(*keys).agg(*(F.sum(c).alias(f"__{o}") for o, c in sums.items()))
    group = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))  # at most n rows a group
    before, whole = (group.orderBy("__range").rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.unboundedFollowing))
    ahead = ranges.select(*keys, *(F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in sums), *(F.sum(f"__{o}").over(whole).alias(f"{o}_total") for o in sums))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *(F.sum(c).over(within).alias(o) for o, c in sums.items()))
    joined = own.join(ahead, _same(keys, own, ahead))
    return joined.select(*(own[c] for c in df.columns), *((own[o] + ahead[f"__{o}"]).alias(o) for o in sums), *(ahead[f"{o}_total"] for o in sums))


def ranked(df: DataFrame, part: list[str], order: list, out: str = "__rank") -> DataFrame:
    """df with each row's place in its part by `order`, from 1."""
    got = running_sums(df.withColumn("__one", F.lit(1)), part, order, {out: "__one"})
    return got.drop("__one", f"{out}_total")


#: Buckets by which a round of a selection narrows the values that may hold the one at a place.
BUCKETS = 4096


def cut_values(df: DataFrame, part: list[str], key: str, want: dict[tuple, int]) -> dict[tuple, tuple[float, int, int]]:
    """For each part of `want` (few parts: a row each goes through the driver): the want-th smallest value of a finite
    numeric key, how many rows are below it, and how many have it. Parts without so many rows, or of which none is wanted, are left out.

    No rows are sorted or moved: a round counts the rows of the values that are left in BUCKETS even steps and keeps the step
    that holds the place, with its own least and greatest value, until these are equal: three rounds for a billion even values."""
    k = F.col(key).cast("double")
    state, done = {}, {}
    for r in df.groupBy(*part).agg(F.count(key).alias("n"), F.min(k).alias("low"), F.max(k).alias("high")).collect():
        p = tuple(r[c] for c in part)
        if 0 < want.get(p, 0) <= r["n"]:
            state[p] = (r["low"], r["high"], 0, r["n"])
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in part), "__low double", "__high double"])
    while True:
        done |= {p: (low, before, n) for p, (low, high, before, n) in state.items() if low == high}
        state = {p: x for p, x in state.items() if p not in done}
        if not state:
            return done
        bounds = df.sparkSession.createDataFrame([(*p, x[0], x[1]) for p, x in state.items()], fields)
        ends = {c: F.lit(x).cast("double") for c, x in zip(("__low", "__high"), next(iter(state.values())))}
        near = df.join(F.broadcast(bounds), _same(part, df, bounds)).drop(*(bounds[c] for c in part)) if part else df.withColumns(ends)
        share = (k / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
        step = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("__step")
        found: dict[tuple, list] = {}
        for r in near.filter(k.between(F.col("__low"), F.col("__high"))).groupBy(*part, step).agg(F.count("*").alias("n"), F.min(k).alias("low"), F.max(k).alias("high")).collect():
            found.setdefault(tuple(r[c] for c in part), []).append((r["__step"], r["n"], r["low"], r["high"]))
        for p, own in found.items():
            before = state[p][2]
            for _, n, low, high in sorted(own):
                if want[p] <= before + n:
                    state[p] = (low, high, before, n)
                    break
                before += n


def first_rows(df: DataFrame, part: list[str], keys: list[str], want: dict[tuple, int]) -> DataFrame:
    """The first want rows of each part (few parts; none of a part that isn't named) by numeric keys, and by the last one, which may be of any type. What the
    first key decides is a filter; only rows that share the value at the cut go on to the next key, the last ones by ranges."""
    key, *rest = keys
    named = [(p, n) for p, n in want.items() if n > 0]
    is_part = lambda p: reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(part, p)), F.lit(True))
    if not rest:
        limit = reduce(lambda acc, x: acc.when(is_part(x[0]), x[1]), named, F.when(F.lit(False), 0)) if named else F.lit(0)
        return ranked(df, part, [key], "__place").filter(F.col("__place") <= F.coalesce(limit.cast("long"), F.lit(0))).drop("__place")
    cuts, open_ = cut_values(df, part, key, want), {}
    keep = F.lit(False)
    for p, n in named:
        if p not in cuts:  # fewer rows than wanted
            keep = keep | is_part(p)
            continue
        value, before, at = cuts[p]
        whole = before + at == n
        keep = keep | (is_part(p) & ((F.col(key) <= value) if whole else (F.col(key) < value)))
        if not whole:
            open_[p] = n - before
    out = df.filter(keep)
    if not open_:
        return out
    ties = df.filter(reduce(Column.__or__, (is_part(p) & (F.col(key) == cuts[p][0]) for p in open_)))
    return out.unionByName(first_rows(ties, part, rest, open_))


def percentiles(df: DataFrame, part: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(part, a column for each of `at`): exact percentiles of the known values, between neighbours in proportion."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("__n"))
    s = running_sums(counts, part, [value], {"__upto": "__n"})
    return s.groupBy(*part).agg(*(_between(value, q).alias(name) for name, q in at.items()))


def _between(value: str, q: float) -> Column:
    """Of rows with distinct values, their counts and running counts: the value at a share q of the order."""
    place = (F.col("__upto_total") - 1) * F.lit(q)
    holds = lambda p: F.max(F.when((F.col("__upto") - F.col("__n") <= p) & (p < F.col("__upto")), F.col(value)))
    low, high, share = holds(F.floor(place)), holds(F.ceil(place)), F.max(place - F.floor(place))
    return low + (high - low) * share
