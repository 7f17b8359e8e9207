"""Boosted trees and isotonic calibration, by Spark's own library."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MISSING = -1e9


def _filled(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"__c_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)) for c in cols})


def train_trees(df: DataFrame, cols: list[str], y: str = "y_fire", split: str = "split", iterations: int = 20, depth: int = 4, seed: int = 42):
    """Trees weighted by class balance, fitted on split 'train' with early stop on 'val'. A missing value counts as one
    below all others, so that a split can set it apart."""
    train = df.filter(F.col(split) == "train")
    n = train.agg(F.count_if(F.col(y) == 1).alias("p"), F.count("*").alias("n")).first()
    weight = max(1.0, (n["n"] - n["p"]) / max(1, n["p"]))
    part = df.filter(F.col(split).isin("train", "val")).withColumns({"__w": F.when(F.col(y) == 1, weight).otherwise(1.0), "__val": F.col(split) == "val", y: F.col(y).cast("double")})
    vec = VectorAssembler(inputCols=[f"__c_{c}" for c in cols], outputCol="__x")
    gbt = GBTClassifier(featuresCol="__x", labelCol=y, weightCol="__w", validationIndicatorCol="__val", maxIter=iterations, maxDepth=depth, seed=seed)
    return cols, vec, gbt.fit(vec.transform(_filled(part, cols)))


def score_trees(df: DataFrame, model, out: str = "p_raw") -> DataFrame:
    cols, vec, gbt = model
    scored = gbt.transform(vec.transform(_filled(df, cols)))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """(tree, node, feature, threshold, prediction, gain) of a model's trees: children of node n are 2n (values up to the
    threshold) and 2n + 1; leaves have no feature. As many rows as the model has nodes."""
    cols, _, gbt = model
    rows = []
    for t, tree in enumerate(gbt.trees):
        todo = [(1, tree._java_obj.rootNode())]
        while todo:
            n, node = todo.pop()
            if node.subtreeDepth() == 0:
                rows.append((t, n, None, None, float(node.prediction()), None))
                continue
            rows.append((t, n, cols[node.split().featureIndex()], float(node.split().threshold()), float(node.prediction()), float(node.gain())))
            todo += [(2 * n, node.leftChild()), (2 * n + 1, node.rightChild())]
    return spark.createDataFrame(rows, "tree int, node long, feature string, threshold double, prediction double, gain double")


def calibrate(val: DataFrame, df: DataFrame, p: str = "p_raw", y: str = "y_fire", out: str = "p_fire") -> DataFrame:
    """Rising fit on `val`, applied to `df`; scores beyond the fitted range take its ends."""
    v = val.select(F.col(p).alias("__f"), F.col(y).cast("double").alias("__y"))
    model = IsotonicRegression(featuresCol="__f", labelCol="__y", predictionCol=out).fit(v)
    return model.transform(df.withColumn("__f", F.col(p))).drop("__f")
