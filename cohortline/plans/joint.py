"""Cross-validated survival analysis: a hazards model and a mixed model per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.clean import min_observations
from cohortline.operators.evaluate import regression_error
from cohortline.operators.folds import FOLD_SEED, fold_by_subject
from cohortline.operators.mixed import mixed_folds
from cohortline.operators.survival import brier_all_times, concordance, cox_fits, integrated_brier, subject_rows, td_auc_all_times
from cohortline.session import materialize


def index_categories(reference: DataFrame, tables: Sequence[DataFrame], column: str) -> list[DataFrame]:
    """Number the categories 0, 1, 2, ... in alphabetical order of ``reference`` in every table.

    Values the reference does not have become null.
    """
    model = StringIndexer(inputCol=column, outputCol="_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(
        reference.select(column).dropna())
    n = len(model.labels)
    return [model.transform(t).withColumn(column, F.when(F.col("_code") < n, F.col("_code"))).drop("_code")
            for t in tables]


def longitudinal_cohort(long: DataFrame, subjects: DataFrame, key: str = "subject_id",
                        diets: Sequence[str] = ("Rod", "Rab")) -> DataFrame:
    """Complete rows of the regular-chow cohort; subjects with one row go first, other diets after.

    A subject can so be left with a single row; the order is the study's.
    """
    kept = subjects.filter((F.col("overall_diet") == "Rod") & F.col("nursing_diet").isin("Rab", "Rod"))
    rows = long.dropna().join(kept.select(key, "nursing_diet"), key)
    rows = min_observations(rows, key, 2).filter(F.col("diet").isin(*diets))
    return rows.drop("diet").withColumnRenamed("nursing_diet", "diet")


def cross_validate_survival(rows: DataFrame, key: str = "subject_id", k: int = 5, seed: int = FOLD_SEED,
                            y: str = "rbg",
                            fixed: Sequence[str] = ("weight", "week", "sex", "diet"),
                            random: Sequence[str] = ("weight", "week"), covariates: Sequence[str] = ("sex", "diet"),
                            max_iter: int = 500) -> DataFrame:
    """Errors of the mixed model and accuracy of the hazards model on each left-out fold of subjects.

    ``own_rmse`` and ``own_mae`` use each left-out subject's effects given its own readings. AUC and Brier scores are at all
    times of a fold's left-out subjects. ``mixed_converged`` and ``cox_converged`` tell whether the fits of a fold reached
    their optimum. The models of all folds are fitted side by side, and each score is one run by fold.
    """
    sex, = index_categories(rows, [rows], "sex")
    coded, = index_categories(sex, [sex], "diet")
    table = materialize(fold_by_subject(coded, key, k, seed, "fold"))
    survival = materialize(subject_rows(table, key, cols=("event_time", "event", "fold", *covariates)))
    folds = [r[0] for r in survival.select("fold").distinct().collect()]  # k numbers

    longitudinal = mixed_folds(table, y, fixed, random, key, "fold", max_iter)
    predicted = materialize(longitudinal.predict(table))
    means = predicted.groupBy("fold", key).agg(F.avg(y).alias(y), F.avg("pred").alias("pred"))

    others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("fold"))
    cox = cox_fits(survival.withColumn("_left_out", F.explode(others)).drop("fold").withColumnRenamed("_left_out", "fold"),
                   "event_time", "event", covariates, "fold")
    scored = materialize(cox.transform(survival).drop("partial_hazard"))
    parts = [
        regression_error(predicted, y, "pred", ["fold"]).select("fold", "rmse", "mae"),
        regression_error(means, y, "pred", ["fold"]).select("fold", F.col("rmse").alias("subject_rmse"), F.col("mae").alias("subject_mae")),
        regression_error(predicted, y, "own", ["fold"]).select("fold", F.col("rmse").alias("own_rmse"), F.col("mae").alias("own_mae")),
        concordance(scored, "event_time", "event", "lp", ["fold"]).select("fold", "c_index"),
        td_auc_all_times(scored, "event_time", "event", "lp", ["fold"]).groupBy("fold").agg(F.avg("auc").alias("mean_auc")),
        integrated_brier(brier_all_times(survival, cox, "event_time", "event"), ["fold"]).select("fold", F.col("ibs").alias("integrated_brier"))]
    results = {f: {"mixed_converged": longitudinal.models[f].converged if f in longitudinal.models else False,
                   "cox_converged": cox.models[f].converged if f in cox.models else False} for f in folds}
    for part in parts:
        for row in part.collect():  # a row for each fold
            results[row["fold"]].update(row.asDict())
    names = ["rmse", "mae", "subject_rmse", "subject_mae", "own_rmse", "own_mae", "c_index", "mean_auc", "integrated_brier"]
    return rows.sparkSession.createDataFrame(
        [(int(f) + 1, *[r.get(n) for n in names], r["mixed_converged"], r["cox_converged"]) for f, r in sorted(results.items())],
        "fold int, " + ", ".join(f"{n} double" for n in names) + ", mixed_converged boolean, cox_converged boolean")
