"""Scores of binary predictions. Order statistics reduce to one row per distinct score, then add up by ranges of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.ordered import running_sums


def _counts(y: str, pred: Column, by: tuple[str, ...]) -> list[Column]:
    pos = F.col(y) == 1
    return [F.count_if(pos & pred).alias("tp"), F.count_if(~pos & pred).alias("fp"), F.count_if(pos & ~pred).alias("fn"), F.count_if(~pos & ~pred).alias("tn")]


def _known(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts at the threshold and the pixel task's ratios, with 1e-8 in each denominator and 1e-6 in Dice."""
    c = _known(df, y, p).groupBy(*by).agg(*_counts(y, F.col(p) >= threshold, by))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": tp / (tp + fp + 1e-8), "recall": tp / (tp + fn + 1e-8)})
    n = tp + fp + fn + tn
    return c.withColumns({
        "f1": 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8), "dice": (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), "accuracy": (tp + tn) / (n + 1e-8),
        "positive_rate_true": F.coalesce(F.try_divide(tp + fn, n), F.lit(0.0)), "positive_rate_pred": F.coalesce(F.try_divide(tp + fp, n), F.lit(0.0)),
    })


def study_metrics(counts: DataFrame) -> DataFrame:
    """The threshold study's ratios of tp, fp, fn, tn: 0 where undefined; balanced accuracy is the mean recall of the
    classes that occur."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.withColumns({"precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": F.coalesce((sens + spec) / 2, sens, spec)})


def _by_score(df: DataFrame, y: str, p: str, by: tuple[str, ...]) -> DataFrame:
    return _known(df, y, p).groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half; null with one class only."""
    s = running_sums(_by_score(df, y, p, by), [*by], [p], {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg"))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Precision and recall at each distinct score, from the highest down."""
    s = running_sums(_by_score(df, y, p, by).withColumn("all", F.col("pos") + F.col("neg")), [*by], [p], {"pos_upto": "pos", "all_upto": "all"})
    above = lambda c: F.col(f"{c}_upto_total") - F.col(f"{c}_upto") + F.col(c)
    s = s.select(*by, F.col(p).alias("threshold"), "pos", above("pos").alias("tp"), above("all").alias("n"), F.col("pos_upto_total").alias("total"))
    return s.select(*by, "threshold", (F.col("tp") / F.col("n")).alias("precision"), F.try_divide(F.col("tp"), F.col("total")).alias("recall"), "pos", "total")


def avg_precision(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Step sum over distinct scores; null without positives."""
    c = pr_curve(df, y, p, by)
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("total")).alias("avg_precision"))


def class_report(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes; 0 where undefined."""
    c = _known(df, y, p).agg(*_counts(y, F.col(p) >= threshold, ()))

    def row(name: str, tp: str, fp: str, fn: str) -> Column:
        a, b, d = (F.col(x).cast("double") for x in (tp, fp, fn))
        zero = lambda u, v: F.coalesce(F.try_divide(u, v), F.lit(0.0))
        return F.struct(F.lit(name).alias("class"), zero(a, a + b).alias("precision"), zero(a, a + d).alias("recall"), zero(2 * a, 2 * a + b + d).alias("f1"), (F.col(tp) + F.col(fn)).alias("support"))

    return c.select(F.inline(F.array(row("no_fire", "tn", "fn", "fp"), row("fire", "tp", "fp", "fn"))))


def floor_metrics(df: DataFrame, y: str = "y") -> DataFrame:
    """What predicting no fire anywhere would score."""
    return binary_metrics(df.withColumn("__p", F.lit(0.0)), y, "__p")


def compare(scored: DataFrame, keys: tuple[str, ...] = ("model", "split"), y: str = "y", p: str = "p") -> DataFrame:
    """(keys, metric, value) of every model on every split."""
    cols = ("precision", "recall", "f1", "dice", "accuracy")
    long = binary_metrics(scored, y, p, by=keys).select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in cols))))
    for f, name in ((roc_auc, "roc_auc"), (avg_precision, "avg_precision")):
        long = long.unionByName(f(scored, y, p, keys).select(*keys, F.lit(name).alias("metric"), F.col(name).alias("value")))
    return long


def alerts(df: DataFrame, k: int = 25, p: str = "p_fire", day: str = "label_date") -> DataFrame:
    """The k most likely cells of each day, ties to the smaller cell, with percent and region."""
    from emberframe.operators.sampling import top_k

    out = top_k(df, k, p, day, "cell_id")
    return out.withColumns({"confidence_pct": (F.col(p) * 100).cast("float"), p: F.col(p).cast("float")})


def pick_day(df: DataFrame, day: str = "label_date", y: str = "y_fire", p: str = "p_fire") -> DataFrame:
    """The day with most positives, or, if there are none, with the highest mean score; ties to the earlier day."""
    return df.groupBy(day).agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.avg(p).alias("mean_p")).orderBy(F.col("n_pos").desc(), F.col("mean_p").desc(), day).limit(1)
