"""Spark ML's boosted trees fitted on groups of rows that no split can tell apart.

A tree of Spark ML splits a feature at one of at most 31 thresholds, so rows whose features fall between the same thresholds go to
the same leaf of every tree. Squared loss needs of such a group its number of rows and its mean label only: the spread of the labels inside is
the same on both sides of every split and leaves the gains as they are. The many passes of a fit then read the groups; the rows are read for
the thresholds (twice for all features) and the grouping. Where few rows fall together there are as many groups as rows, and the fit is the plain one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.explain import tree_tables

GROUPS_PER_TASK = 50_000  # of a fit, whose passes are many


def feature_thresholds(rows: DataFrame, params: dict) -> list[list[float]]:
    """Every feature's thresholds as Spark ML picks them from these rows with this seed: what its trees' own search for splits returns."""
    jvm = rows.sparkSession.sparkContext._jvm
    ml, tree = jvm.org.apache.spark.ml, jvm.org.apache.spark.ml.tree.impl
    own = lambda package, name: getattr(getattr(package, name + "$"), "MODULE$")  # noqa: E731  a Scala object
    gbt = GBTRegressor(featuresCol="features", labelCol="y", **params)
    gbt._transfer_params_to_java()
    instances = own(ml.util, "DatasetUtils").extractInstances(gbt._java_obj, rows._jdf, jvm.scala.Option.empty())
    strategy = jvm.org.apache.spark.mllib.tree.configuration.Strategy.defaultStrategy("Regression")
    metadata = own(tree, "DecisionTreeMetadata").buildMetadata(instances, strategy, 1, "all")
    found = own(tree, "RandomForest").findSplits(instances, metadata, params["seed"])
    return [[float(split.threshold()) for split in feature] for feature in found]


class GroupedTrees:
    """Spark ML's model on bin numbers (thresholds below a value) with the thresholds that make them; scores rows by ``features``."""

    def __init__(self, model, thresholds: Sequence[Sequence[float]]):
        self.model, self.thresholds, self.base = model, thresholds, 0.0

    def __getattr__(self, name):
        if name in ("trees", "treeWeights", "featureImportances", "totalNumNodes"):
            return getattr(self.model, name)
        raise AttributeError(name)

    def node_tables(self) -> list[tuple[float, list[dict]]]:
        """Weight and nodes of every tree, with the features' own thresholds."""
        return [(w, [n if n["f"] < 0 else n | {"thr": self.thresholds[n["f"]][math.floor(n["thr"])]} for n in nodes])
                for w, nodes in tree_tables(self.model)]

    def transform(self, df: DataFrame) -> DataFrame:
        bins = with_bins(df, self.thresholds).withColumnRenamed("features", "_raw").withColumn("features", array_to_vector("_bins"))
        return self.model.transform(bins.drop("_bins")).drop("features").withColumnRenamed("_raw", "features")


def with_bins(df: DataFrame, thresholds: Sequence[Sequence[float]]) -> DataFrame:
    """``_bins``: per feature, the number of thresholds below its value."""
    x = vector_to_array("features")
    used = [j for j, t in enumerate(thresholds) if t]
    out = df.select("*", *[x[j].alias(f"_x{j}") for j in used])
    if used:    # a bucket begins at the next number after a threshold: a value at the threshold belongs to the left
        splits = [[-math.inf, *[float(np.nextafter(t, math.inf)) for t in thresholds[j]], math.inf] for j in used]
        out = Bucketizer(splitsArray=splits, inputCols=[f"_x{j}" for j in used], outputCols=[f"_b{j}" for j in used], handleInvalid="error").transform(out)
    return out.select(*df.columns, F.array(*[F.col(f"_b{j}") if thresholds[j] else F.lit(0.0) for j in range(len(thresholds))]).alias("_bins"))


def fit_grouped_trees(rows: DataFrame, params: dict) -> GroupedTrees:
    """``GBTRegressor`` with ``params`` on rows (features, y), which are read some times per feature (keep them)."""
    return fit_groups(*group_rows(rows, params), params)


def group_rows(rows: DataFrame, params: dict) -> tuple[DataFrame, int, float, list[list[float]]]:
    """(groups, kept and counted; how many; rows in them; thresholds)"""
    thresholds = feature_thresholds(rows, params)
    groups = with_bins(rows, thresholds).groupBy("_bins").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("y")).persist()
    return groups, *groups.agg(F.count(F.lit(1)), F.sum("n")).first(), thresholds


def fit_groups(groups: DataFrame, n_groups: int, n: float, thresholds: list[list[float]], params: dict) -> GroupedTrees:
    try:
        few = params["minInstancesPerNode"]                  # counts rows; a fit on groups sees them as weight
        fitted = dict(params) | {"minInstancesPerNode": 1}
        if few > 1:
            fitted |= {"minWeightFractionPerNode": (few - 0.5) / n} if n >= 2 * few else {"maxDepth": 0}
        # every group is looked at for the splits between bins (Spark ML samples more rows than the square of this)
        fitted["maxBins"] = max(32, math.isqrt(n_groups) + 1)
        data = groups.select(array_to_vector("_bins").alias("features"), "n", "y").coalesce(max(1, math.ceil(n_groups / GROUPS_PER_TASK))).persist()
        try:
            model = GBTRegressor(featuresCol="features", labelCol="y", weightCol="n", predictionCol="pred", **fitted).fit(data)
        finally:
            data.unpersist()
    finally:
        groups.unpersist()
    return GroupedTrees(model, thresholds)
