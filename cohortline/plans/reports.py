"""The study's analyses end to end, from readings and onset table to result tables.

Each function is one lazy plan or a short series of aggregations. Give them written tables: most
read the panel and the onset table more than once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import encode_flag
from cohortline.operators import incidence, stats
from cohortline.operators.clean import (
    DELETED_MEASUREMENTS, WEEK_CORRECTIONS, apply_corrections, clean_measurements, clean_subjects, drop_keys, on_grid)
from cohortline.operators.evaluate import classification_report, feature_roc, roc_auc, roc_curve
from cohortline.operators.folds import split
from cohortline.operators.lineage import sibling_onset
from cohortline.operators.onset import cohort, cox_input, eligible, onset_groups, onset_table
from cohortline.operators.panel import pivot_weeks
from cohortline.operators.survival import CoxModel, cox_ph
from cohortline.plans.features import SWEEP_OPTIONS, feature_table, risk_table, with_label
from cohortline.plans.models import importances, tree_rules
from cohortline.plans.selection import compare_models, feature_sweep, rfe_cv, tuned_report
from cohortline.plans.settings import ANALYSES, FULL_COMPARISON, LINEAGE_FOREST_GRID, LINEAGE_TREE_GRID, SPLIT_SEED, SPLIT_TEST
from cohortline.session import materialize

CUTOFFS = {"M": 16, "F": 36}


def load_study(subjects: DataFrame, measurements: DataFrame, key: str = "NR_Name") -> tuple[DataFrame, DataFrame]:
    """Raw exported tables to the cleaned panel and the onset table; the panel is written once."""
    readings = materialize(clean_measurements(measurements))
    return readings, onset_table(clean_subjects(subjects), readings, key)


def corrected(measurements: DataFrame, measurement_id: str = "measurement_id") -> DataFrame:
    """The panel with mistyped weeks put right and bad rows deleted."""
    fixed = apply_corrections(measurements, WEEK_CORRECTIONS, measurement_id, "week")
    return drop_keys(fixed, DELETED_MEASUREMENTS, measurement_id)


def readings_by_diet(measurements: DataFrame, onset: DataFrame, key: str = "subject_id",
                     grid: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histogram, kernel density and box summary of readings by diet, for subjects kept on one diet."""
    kept = onset.filter(((F.col("overall_diet") == "Rod") | (F.col("weanling_diet") == "Rab"))
                        & (F.col("weanling_diet") == F.col("overall_diet")))
    rows = materialize(measurements.join(kept.select(key), key, "left_semi")
                       .filter(F.col("diet").isin("Rod", "Rab")).select("rbg", "diet"))
    return (stats.histogram(rows, "rbg", ("diet",), 10.0), stats.kde(rows, "rbg", ("diet",), grid),
            stats.box_summary(rows, "rbg", ("diet",)))


def incidence_report(onset: DataFrame, weeks: int = 40) -> dict[str, DataFrame]:
    """Incidence by sex and maternal diet, its pivot, survival, and bands with the pooled group size."""
    counts = materialize(incidence.incidence_by_diet(onset, weeks=weeks, drop_week=None))
    shown = counts.filter(F.col("rbg200") != 4)
    pivot = incidence.incidence_pivot(shown)
    survival = incidence.survival_percent(pivot)
    sizes = counts.groupBy("sex").agg(F.sum("count").alias("n"))
    return {"incidence": shown, "pivot": pivot, "survival": survival, "bands": incidence.binomial_band(survival, sizes)}


def diet_hazards(onset: DataFrame, weeks: int = 40, key: str = "subject_id") -> dict[str, CoxModel]:
    """Hazard of onset by maternal diet, one model per sex."""
    kept = cohort(onset, overall_diet="Rod", weanling_diet="Rod", nursing_diet=("Rod", "Rab"))
    kept = incidence.followed_up(kept.filter(F.col("gestational_diet") == F.col("nursing_diet")), weeks)
    rows = materialize(cox_input(kept, weeks, key=key))
    return {s: cox_ph(rows.filter(F.col("sex") == s), "duration", "event", ["diet"]) for s in ("M", "F")}


def weight_report(measurements: DataFrame, onset: DataFrame, cutoffs: Mapping[str, int] | None = None,
                  last_week: int = 40, key: str = "subject_id") -> dict[str, DataFrame]:
    """Weight by week of the onset and no-onset groups: counts, box summaries, Welch tests, overlap."""
    kept = cohort(onset, overall_diet="Rod", weanling_diet="Rod", nursing_diet="Rod")
    groups = onset_groups(kept, cutoffs or CUTOFFS).select(key, "sex", "onset_group")
    rows = on_grid(measurements).filter((F.col("week") <= last_week) & F.col("weight").isNotNull())
    rows = materialize(rows.select(key, "week", "weight").join(groups, key))
    first, second = (rows.filter(F.col("onset_group") == g) for g in ("onset", "no onset"))
    return {"counts": stats.group_counts(rows, key, "weight", ("sex", "onset_group")),
            "box": stats.box_summary(rows, "weight", ("sex", "week", "onset_group")),
            "welch": stats.welch_ttest(rows, "weight", "onset_group", ("onset", "no onset"), ("sex", "week")),
            "overlap": stats.overlap(first, second, key)}


def growth_report(measurements: DataFrame, onset: DataFrame, cutoffs: Mapping[str, int] | None = None,
                  key: str = "subject_id") -> dict[str, DataFrame]:
    """Percent growth from week 4 to 8 of both groups: box summaries and Welch tests."""
    kept = cohort(onset, overall_diet="Rod", weanling_diet="Rod", nursing_diet="Rod")
    groups = onset_groups(kept, cutoffs or CUTOFFS).select(key, "sex", "onset_group")
    rows = materialize(stats.growth(measurements, key).join(groups, key))
    return {"box": stats.box_summary(rows, "percent_increase", ("sex", "onset_group")),
            "welch": stats.welch_ttest(rows, "percent_increase", "onset_group", ("onset", "no onset"), ("sex",))}


def early_table(measurements: DataFrame, onset: DataFrame, last_week: int, key: str = "subject_id",
                weeks: Sequence[int] = (4, 8, 12)) -> DataFrame:
    """Corrected early readings by week with sex, diet flags and onset of subjects on regular chow."""
    weeks = [w for w in weeks if w <= last_week]
    wide = pivot_weeks(corrected(measurements), key, weeks, {"weight": "wt", "rbg": "rbg"})
    subjects = cohort(onset, overall_diet="Rod").select(
        key, "sex", *[encode_flag(d, "Rod").cast("int").alias(d) for d in ("gestational_diet", "nursing_diet")], "rbg200")
    return wide.join(subjects, key, "left")


def correlation_report(measurements: DataFrame, onset: DataFrame, key: str = "subject_id") -> DataFrame:
    """Correlation of early readings, maternal diet and onset week, per sex."""
    table = early_table(measurements, onset, 12, key).filter(F.col("sex").isNotNull())
    return stats.corr_matrix(table, [c for c in table.columns if c not in (key, "sex")], ("sex",))


def model_comparison(measurements: DataFrame, onset: DataFrame, families: Mapping[str, dict[str, Any]] | None = None,
                     folds: int = 5, repeats: int = 10, key: str = "subject_id") -> DataFrame:
    """Fold scores of all models on the complete early readings, by sex with its own cutoff."""
    families = families or {f: {} for f in FULL_COMPARISON}
    table = with_label(early_table(measurements, onset, 8, key).dropna(), ANALYSES["comparison"]["cutoff"])
    features = [c for c in table.columns if c not in (key, "sex", "rbg200", "label")]
    return compare_models(table, families, features, folds, repeats, key=key)


def sweep_report(measurements: DataFrame, onset: DataFrame, analysis: str = "sweep_forest",
                 grid: Mapping[str, Sequence] | None = None, options: Sequence[Sequence[str]] = SWEEP_OPTIONS,
                 k: int = 5, percentile: str | None = "weight percentile", key: str = "subject_id") -> DataFrame:
    """The tuned model of every feature list; ``analysis`` picks the family, cutoff, grid and score."""
    setting = ANALYSES[analysis]
    measures = {"weight": "wt", "rbg": "rbg"} | ({percentile: "wtpt"} if percentile else {})
    table = feature_table(measurements, onset, measures=measures, diet_values=("Rab",), key=key, keep=("sex", "rbg200"))
    return feature_sweep(with_label(table, setting["cutoff"]), setting["family"], grid or setting["grid"], options, k,
                         setting["metric"], key=key)


def tree_report(measurements: DataFrame, onset: DataFrame, analysis: str = "tree",
                grid: Mapping[str, Sequence] | None = None, features: Sequence[str] | None = None, k: int = 5,
                key: str = "subject_id") -> dict[str, DataFrame]:
    """The tuned tree with its rules, importances, report and, per feature, ROC curves.

    Analysis ``tree`` takes subjects on regular chow, ``tree_sibling`` those whose label is known and adds
    the siblings' onset. As the study did, the AUC of a tree is that of its predicted classes.
    """
    setting = ANALYSES[analysis]
    features = list(features or setting["features"])
    base = cohort(onset, overall_diet="Rod")
    cutoffs = {"M": setting["cutoff"], "F": setting["cutoff"]}
    if analysis == "tree_sibling":
        base = eligible(base, cutoffs)
    table = materialize(feature_table(measurements, base, (4, 8), diet_values=("Rab",), key=key,
                                      keep=("mother", "father", "sex", "rbg200")))
    if "rbg200_sib" in features:
        table = sibling_onset(table, cutoffs, key=key)
    table = with_label(table, setting["cutoff"])
    return _tree_tables(table, "tree", features, grid or setting["grid"], setting["metric"], k, key)


def _tree_tables(table: DataFrame, family: str, features: Sequence[str], grid: Mapping[str, Sequence], metric: str,
                 k: int, key: str) -> dict[str, DataFrame]:
    spark = table.sparkSession
    numbers = {"sex": (F.col("sex") == "M").cast("int")} if "sex" in features else {}
    table = materialize(table.withColumns(numbers).dropna(subset=list(features)))
    model, settings, predicted = tuned_report(table, family, features, grid, k, metric, key=key,
                                              test=SPLIT_TEST, split_seed=SPLIT_SEED)
    predicted = materialize(predicted)
    score = "prediction" if family == "tree" else "probability"
    out = {"settings": settings, "importances": importances(spark, model), "predictions": predicted,
           "report": classification_report(predicted, "label", "prediction"),
           "roc": roc_curve(predicted, "label", score), "auc": roc_auc(predicted, "label", score),
           "feature_roc": feature_roc(split(table, key, SPLIT_TEST, SPLIT_SEED)[1], "label", features)}
    if family == "tree":
        out["rules"] = tree_rules(spark, model)
    return out


def risk_report(measurements: DataFrame, onset: DataFrame, cutoffs: Mapping[str, int] | None = None,
                features: Sequence[str] = ("gestational_diet", "nursing_diet", "wt4", "wt8", "wt12"),
                history: Sequence[str] = ("family_history",), family: str = "forest",
                grid: Mapping[str, Sequence] | None = None, k: int = 5, strict: bool = True,
                key: str = "subject_id") -> dict[str, dict[str, DataFrame]]:
    """Tuned forests (or trees) with family history, one per sex.

    ``history`` is ``family_history``, or any of ``rbg200_fa``, ``rbg200_mo`` and ``rbg200_sib``, or empty.
    """
    grid = grid or (LINEAGE_FOREST_GRID if family == "forest" else LINEAGE_TREE_GRID)
    table = materialize(risk_table(measurements, onset, cutoffs or ANALYSES["forest_lineage"]["cutoff"], features,
                                   strict=strict, key=key))
    metric = "auc" if family == "forest" else "accuracy"
    return {s: _tree_tables(table.filter(F.col("sex") == s), family, [*features, *history], grid, metric, k, key)
            for s in ("M", "F")}


def elimination_report(measurements: DataFrame, onset: DataFrame, cutoffs: Mapping[str, int] | None = None,
                       features: Sequence[str] = ("gestational_diet", "nursing_diet", "wt4", "wt8", "wt12"),
                       history: Sequence[str] = ("family_history",), k: int = 5,
                       key: str = "subject_id") -> dict[str, DataFrame]:
    """Feature ranking by recursive elimination, one per sex."""
    table = materialize(risk_table(measurements, onset, cutoffs or ANALYSES["forest_lineage"]["cutoff"], features, key=key))
    return {s: rfe_cv(table.filter(F.col("sex") == s), [*features, *history], k=k, key=key)[1] for s in ("M", "F")}
