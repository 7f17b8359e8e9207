"""Search for daily threshold rules, and their use.

Rules are not run over days one by one: days reduce to counts of (capped) feature values, and the counts of all
thresholds are suffix sums over small grids. The cost is one pass over the days, whatever the number of rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.metrics import study_metrics

#: Features of single rules, pairs of combined ones, and the highest thresholds, fixed values.
SINGLE = ("n_fire_pixels_label", "n_conf_ge_30", "n_conf_ge_50", "n_conf_ge_60", "n_conf_ge_70", "n_conf_ge_80", "n_t21_ge_325", "n_t21_ge_350", "n_t21_ge_375", "n_both_conf60_t21325", "n_both_conf70_t21350")
PAIRS = (("n_conf_ge_60", "n_t21_ge_325"), ("n_conf_ge_70", "n_t21_ge_350"), ("n_both_conf60_t21325", "n_fire_pixels_label"), ("n_both_conf70_t21350", "n_fire_pixels_label"))
MOST_SINGLE, MOST_PAIR = 200, 50


def _suffix(part: list[str], order: str):
    return Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)


def rule_counts(df: DataFrame, target: str, single: tuple[str, ...] = SINGLE, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """(rule_type, feature_1, threshold_1, feature_2, threshold_2, n, n_pos): days, and positive days, that each rule
    calls. Thresholds run from 1 to the feature's maximum, at least 2 and at most 200 (single) or 50 (pairs)."""
    y = (F.col(target) == 1).cast("long")
    one = df.select(F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.floor(f).cast("long").alias("v")) for f in single))), y.alias("y"))
    tops = one.groupBy("f").agg(F.greatest(F.lit(2), F.least(F.max("v"), F.lit(MOST_SINGLE))).alias("top"))
    hist = one.groupBy("f", F.least("v", F.lit(MOST_SINGLE)).alias("v")).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))
    spine = tops.select("f", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias("v"))
    full = spine.join(hist, ["f", "v"], "left").unionByName(hist.join(spine, ["f", "v"], "left_anti").filter("v > 0"))
    w = _suffix(["f"], "v")
    sums = full.select("f", "v", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("n_pos").over(w), F.lit(0)).alias("n_pos")).join(spine, ["f", "v"], "left_semi")
    none = F.lit(None).cast("string")
    singles = sums.select(F.lit("single").alias("rule_type"), F.col("f").alias("feature_1"), F.col("v").alias("threshold_1"), none.alias("feature_2"), F.lit(None).cast("long").alias("threshold_2"), "n", "n_pos")

    two = df.select(F.inline(F.array(*(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.floor(a).cast("long").alias("v1"), F.floor(b).cast("long").alias("v2")) for a, b in pairs))), y.alias("y"))
    tops = two.groupBy("f1", "f2").agg(*(F.greatest(F.lit(2), F.least(F.max(v), F.lit(MOST_PAIR))).cast("long").alias(t) for v, t in (("v1", "t1"), ("v2", "t2"))))
    cells = two.join(tops, ["f1", "f2"]).groupBy("f1", "f2", F.least("v1", "t1").alias("v1"), F.least("v2", "t2").alias("v2")).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))
    # From 0 on: the sums at 0 are those of one feature alone.
    grid = tops.select("f1", "f2", F.explode(F.sequence(F.lit(0).cast("long"), "t1")).alias("v1"), "t2").select("f1", "f2", "v1", F.explode(F.sequence(F.lit(0).cast("long"), "t2")).alias("v2"))
    full = grid.join(cells, ["f1", "f2", "v1", "v2"], "left").fillna(0, ["n", "n_pos"])
    for order, other in (("v1", "v2"), ("v2", "v1")):
        w = _suffix(["f1", "f2", other], order)
        full = full.withColumns({c: F.sum(c).over(w) for c in ("n", "n_pos")})
    both = Window.partitionBy("f1", "f2", "v1")
    alone = Window.partitionBy("f1", "f2", "v2")
    full = full.withColumns({f"{c}_1": F.max(F.when(F.col("v2") == 0, F.col(c))).over(both) for c in ("n", "n_pos")} | {f"{c}_2": F.max(F.when(F.col("v1") == 0, F.col(c))).over(alone) for c in ("n", "n_pos")}).filter("v1 > 0 AND v2 > 0")
    name = [F.col("f1").alias("feature_1"), F.col("v1").alias("threshold_1"), F.col("f2").alias("feature_2"), F.col("v2").alias("threshold_2")]
    ands = full.select(F.lit("and").alias("rule_type"), *name, "n", "n_pos")
    ors = full.select(F.lit("or").alias("rule_type"), *name, *((F.col(f"{c}_1") + F.col(f"{c}_2") - F.col(c)).alias(c) for c in ("n", "n_pos")))
    return reduce(DataFrame.unionByName, (singles, ands, ors))


def search_rules(df: DataFrame, target: str, single: tuple[str, ...] = SINGLE, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """All rules with their counts and ratios, best first: F1, balanced accuracy, recall, precision, then the rule."""
    total = df.agg(F.count("*").alias("days"), F.sum((F.col(target) == 1).cast("long")).alias("positives"))  # one row
    c = rule_counts(df, target, single, pairs).crossJoin(F.broadcast(total))
    counts = c.select("rule_type", "feature_1", "threshold_1", "feature_2", "threshold_2", F.col("n_pos").alias("tp"), (F.col("n") - F.col("n_pos")).alias("fp"), (F.col("positives") - F.col("n_pos")).alias("fn"), (F.col("days") - F.col("positives") - F.col("n") + F.col("n_pos")).alias("tn"))
    return study_metrics(counts).orderBy(*(F.col(x).desc() for x in ("f1", "balanced_accuracy", "recall", "precision")), "rule_type", "feature_1", "threshold_1", "feature_2", "threshold_2")


def apply_rule(df: DataFrame, rule: dict, out: str = "predicted_fire_day_best") -> DataFrame:
    """0/1 by a rule of search_rules."""
    first = F.col(rule["feature_1"]) >= rule["threshold_1"]
    if rule["rule_type"] != "single":
        second = F.col(rule["feature_2"]) >= rule["threshold_2"]
        first = first | second if rule["rule_type"] == "or" else first & second
    return df.withColumn(out, first.cast("int"))
