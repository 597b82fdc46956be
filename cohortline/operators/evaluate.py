"""Evaluation of predictions: reports, ROC curves, errors.

Everything is computed from counts per (label, prediction) or per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.running import cut_axis, running_totals
from cohortline.operators.stats import _join_by


def regression_error(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def cohort_counts(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag).cast("boolean")).alias("positives"))


def score_summary(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of validation scores."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("sd_score"))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Ratios with nothing in the denominator are 0.
    """
    cells = df.groupBy(F.col(y).cast("int").alias("_y"), F.col(pred).cast("int").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("_y").alias("c"), F.col("_n").alias("support"), hit.alias("tp"), zero.alias("predicted")),
        F.struct(F.col("_p").alias("c"), zero.alias("support"), zero.alias("tp"), F.col("_n").alias("predicted")))
    per = (cells.select(F.explode(sides).alias("_s")).select("_s.*").groupBy("c")
           .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    per = (per.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
           .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                     F.col("precision") + F.col("recall")), F.lit(0.0))))
    classes = per.select(F.col("c").cast("string").alias("row"), "precision", "recall", "f1", "support")
    measures = ("precision", "recall", "f1")
    total = per.agg(
        F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("acc"),
        *[F.avg(m).alias(f"m_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in measures])
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), *[F.col("acc").alias(m) for m in measures], F.col("support")),
        F.struct(F.lit("macro avg").alias("row"), *[F.col(f"m_{m}").alias(m) for m in measures], F.col("support")),
        F.struct(F.lit("weighted avg").alias("row"), *[F.col(f"w_{m}").alias(m) for m in measures], F.col("support")))
    return classes.unionByName(total.select(F.explode(rows).alias("_r")).select("_r.*"))


def _score_counts(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score, with running counts from the highest score down."""
    positive = F.col(y).cast("int")
    counts = (df.select(*by, positive.alias("_y"), F.col(score).cast("double").alias("score")).dropna(subset=["_y", "score"])
              .groupBy(*by, "score").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")))
    return counts


def roc_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """False and true positive rates at every threshold, per group of ``by``.

    Starts at (0, 0) with an infinite threshold. ``drop_intermediate`` leaves out points inside a
    straight stretch of counts, where neither rate changes its step.
    """
    by = list(by)
    counts = cut_axis(_score_counts(df, y, score, by).withColumn("_one", F.lit(1).cast("long")), "score")
    curve = running_totals(counts, "score", {"_tp": "pos", "_fp": "neg", "_rank": "_one"}, by, descending=True,
                           range_col="_range")
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum("_one").alias("_last"))
    if drop_intermediate:
        following = curve.select(*[F.col(c).alias(f"_f_{c}") for c in by], (F.col("_rank") - 1).alias("_f_rank"),
                                 F.col("pos").alias("_f_pos"), F.col("neg").alias("_f_neg"))
        on = F.col("_rank") == F.col("_f_rank")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        curve = curve.join(following, on, "left")
        keep = ((F.col("_rank") == 1) | F.col("_f_pos").isNull()
                | (F.col("pos") != F.col("_f_pos")) | (F.col("neg") != F.col("_f_neg")))
        curve = curve.filter(keep)
    points = _join_by(curve.select(*by, "score", "_tp", "_fp"), totals, by)
    rated = points.select(*by, F.try_divide("_fp", "_n").alias("fpr"), F.try_divide("_tp", "_p").alias("tpr"),
                          F.col("score").alias("threshold"))
    start = totals.select(*by, F.when(F.col("_n") > 0, F.lit(0.0)).alias("fpr"),
                          F.when(F.col("_p") > 0, F.lit(0.0)).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return start.unionByName(rated)


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing."""
    by = list(by)
    counts = _score_counts(df, y, score, by)
    curve = running_totals(counts, "score", {"_below": "neg"}, by)
    wins = F.col("pos") * (F.col("_below") - F.col("neg") / 2)
    out = curve.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("_w"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.select(*by, "n_pos", "n_neg", F.try_divide("_w", pairs).alias("auc"))


def features_long(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    return df.select(y, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [y], list(features), "feature", "score")


def feature_auc(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """AUC of every feature taken as a score by itself, all in one job."""
    return roc_auc(features_long(df, y, features), y, "score", ("feature",))


def feature_roc(df: DataFrame, y: str, features: Sequence[str], drop_intermediate: bool = True) -> DataFrame:
    """ROC curve of every feature taken as a score by itself."""
    return roc_curve(features_long(df, y, features), y, "score", ("feature",), drop_intermediate)
