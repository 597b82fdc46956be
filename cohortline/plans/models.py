"""Risk classifiers on one interface: MLlib estimators, and the neighbour vote as a DataFrame job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.operators.neighbours import knn_classify

MAX_BINS = 1024  # default of ``max_bins``, split candidates per feature; whole-number readings have fewer values than this
MAX_DEPTH = 30  # default of ``max_depth``, the deepest tree there is: trees grow until their leaves are pure


def as_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles: flags 0/1, sex 1 for male."""
    types = dict(df.dtypes)
    out = {}
    for f in features:
        c = F.col(f)
        if types[f] == "string":
            c = F.when(c == "M", 1.0).when(c.isNotNull(), 0.0)
        out[f] = c.cast("double")
    return df.withColumns(out)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Complete rows with the features as one vector column."""
    numbers = as_numbers(df, features).dropna(subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(numbers)


@dataclass
class FittedModel:
    """A trained classifier: ``transform`` adds ``prediction`` and ``probability`` of label 1."""

    family: str
    params: dict[str, Any]
    features: list[str]
    key: str
    _apply: Callable[[DataFrame], DataFrame]
    native: Any = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df)


def _mllib(family: str, params: dict[str, Any], n: int, width: int, label: str, seed: int):
    """The estimator of a family; penalties are given as in the study, per row instead of in total."""
    if family == "tree":
        return DecisionTreeClassifier(labelCol=label, impurity=params.get("criterion", "gini"), maxBins=params.get("max_bins", MAX_BINS),
                                      maxDepth=params.get("max_depth", MAX_DEPTH), seed=seed)
    if family == "forest":
        return RandomForestClassifier(labelCol=label, impurity=params.get("criterion", "gini"), maxBins=params.get("max_bins", MAX_BINS),
                                      maxDepth=params.get("max_depth", MAX_DEPTH), numTrees=params.get("n_trees", 100), seed=seed)
    if family in ("logistic", "lasso"):
        return LogisticRegression(labelCol=label, regParam=1.0 / (params.get("c", 1.0) * max(n, 1)),
                                  elasticNetParam=1.0 if family == "lasso" else 0.0, standardization=False,
                                  maxIter=params.get("max_iter", 500), tol=1e-9)
    if family == "perceptron":
        return MultilayerPerceptronClassifier(labelCol=label, layers=[width, *params.get("hidden", (100,)), 2],
                                              maxIter=params.get("max_iter", 1000), seed=seed)
    raise ValueError(f"unknown model family {family}")


def fit_model(family: str, train: DataFrame, features: Sequence[str], label: str = "label", key: str = "subject_id",
              params: dict[str, Any] | None = None, seed: int = 888) -> FittedModel:
    """Train one classifier of a family: tree, forest, logistic, lasso, ridge, perceptron or knn."""
    features, params = list(features), dict(params or {})
    if family == "knn":
        stored = as_numbers(train, features)

        def vote(df: DataFrame) -> DataFrame:
            found = knn_classify(stored, as_numbers(df, features), features, key, label, k=params.get("k", 5),
                                 weights=params.get("weights", "uniform"), p=params.get("p", 2))
            return df.join(found.withColumn("prediction", F.col("prediction").cast("double")), key)

        return FittedModel(family, params, features, key, vote)

    rows = assemble(train, features).withColumn(label, F.col(label).cast("double"))
    if family == "ridge":
        return _fit_ridge(rows, features, label, key, params)
    needs_size = family in ("logistic", "lasso")
    n = rows.count() if needs_size else 0
    model = _mllib(family, params, n, len(features), label, seed).fit(rows)

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(assemble(df, features))
        return out.select(*df.columns, "prediction", vector_to_array("probability")[1].alias("probability"))

    return FittedModel(family, params, features, key, apply, model)


def _fit_ridge(rows: DataFrame, features: list[str], label: str, key: str, params: dict[str, Any]) -> FittedModel:
    """Least squares on -1/+1 labels with a squared penalty; the sign decides.

    The estimator scales labels to unit variance but not the penalty with them, hence the factor.
    """
    signed = rows.withColumn(label, F.col(label) * 2 - 1)
    size = signed.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    penalty = params.get("alpha", 1.0) / max(size["n"], 1) * (size["sd"] or 1.0)
    model = LinearRegression(labelCol=label, regParam=penalty, elasticNetParam=0.0, standardization=False,
                             solver="normal").fit(signed)

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(assemble(df, features)).withColumnRenamed("prediction", "_margin")
        return out.select(*df.columns, F.when(F.col("_margin") > 0, 1.0).otherwise(0.0).alias("prediction"),
                          F.col("_margin").alias("probability"))

    return FittedModel("ridge", params, features, key, apply, model)


def param_grid(grid: dict[str, Sequence]) -> list[dict[str, Any]]:
    """All combinations of the settings."""
    names = list(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def importances(spark: SparkSession, model: FittedModel) -> DataFrame:
    """Feature importances of a tree or forest, with names."""
    values = model.native.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(model.features, values)],
                                 "feature string, importance double")


def coefficients(spark: SparkSession, model: FittedModel) -> DataFrame:
    """Coefficients and intercept of a linear model."""
    rows = [(f, float(v)) for f, v in zip(model.features, model.native.coefficients.toArray())]
    return spark.createDataFrame([*rows, ("intercept", float(model.native.intercept))], "term string, coef double")


def tree_rules(spark: SparkSession, model: FittedModel) -> DataFrame:
    """A tree as text, one line per rule, with feature names put in."""
    lines = []
    for i, line in enumerate(model.native.toDebugString.splitlines()):
        for j in range(len(model.features) - 1, -1, -1):
            line = line.replace(f"feature {j} ", f"{model.features[j]} ")
        lines.append((i, line))
    return spark.createDataFrame(lines, "line int, rule string")
