"""Feature tables of the risk models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import by_sex, encode_flag
from cohortline.operators.clean import on_grid
from cohortline.operators.lineage import lineage_features
from cohortline.operators.onset import eligible
from cohortline.operators.panel import pivot_weeks
from cohortline.session import materialize

DIETS = ("gestational_diet", "nursing_diet", "weanling_diet")
MEASURES = {"weight": "wt", "rbg": "rbg"}

# The sixteen feature lists that the model sweep compares.
_EXTRA = ([], ["gestational_diet"], ["nursing_diet"], ["nursing_diet", "gestational_diet"])
_READINGS = (["wt4", "wt8", "rbg4", "rbg8"], ["wtpt4", "wtpt8", "rbg4", "rbg8"],
             ["wt4", "wt8", "wt12", "rbg4", "rbg8", "rbg12"],
             ["wtpt4", "wtpt8", "wtpt12", "rbg4", "rbg8", "rbg12"])
SWEEP_OPTIONS = [["sex", *extra, *readings] for extra in _EXTRA for readings in _READINGS]


def feature_table(measurements: DataFrame, onset: DataFrame, weeks: Sequence[int] = (4, 8, 12),
                  measures: Mapping[str, str] | None = None, diets: Sequence[str] = DIETS,
                  diet_values: Sequence[str] = ("Rod", "New"), key: str = "subject_id",
                  keep: Sequence[str] = ("mother", "father", "sex", "rbg200"), how: str = "inner",
                  strict: bool = True) -> DataFrame:
    """One row per subject: readings by week, diet flags, growth from week 4 to 8, onset week.

    Readings of all measures are pivoted in one aggregation, which leaves the rows partitioned by
    the key that the join to the subjects needs.
    """
    measures = dict(measures or MEASURES)
    wide = pivot_weeks(on_grid(measurements), key, weeks, measures, strict=strict)
    subjects = onset.select(key, *keep, *[encode_flag(d, *diet_values).alias(d) for d in diets])
    out = wide.join(subjects, key, how)
    if "wt" in measures.values() and {4, 8} <= set(weeks):
        out = out.withColumn("diff48", F.col("wt8") - F.col("wt4"))
    return out


def label(cutoff: int | Mapping[str, int], onset: str = "rbg200", sex: str = "sex") -> Column:
    """Crossed by the cutoff week, one for all or one per sex; a missing week is no onset."""
    limit = by_sex(sex, cutoff) if isinstance(cutoff, Mapping) else F.lit(cutoff)
    return F.coalesce(F.col(onset) <= limit, F.lit(False))


def with_label(df: DataFrame, cutoff: int | Mapping[str, int], name: str = "label", onset: str = "rbg200") -> DataFrame:
    return df.withColumn(name, label(cutoff, onset).cast("int"))


def risk_table(measurements: DataFrame, onset: DataFrame, cutoffs: Mapping[str, int],
               features: Sequence[str] = ("gestational_diet", "nursing_diet", "wt4", "wt8", "wt12"),
               weeks: Sequence[int] = (4, 8, 12), strict: bool = True, exclude_above: float | None = 200,
               overall_diet: str | None = "Rod", key: str = "subject_id", crossing: str = "rbg200") -> DataFrame:
    """The full feature table of the forest model: cohort, readings, lineage and label, by sex cutoffs.

    Subjects missing a chosen feature are dropped after siblings have been counted. Those already
    above ``exclude_above`` at week 8 are left out when that reading is a feature.
    """
    base = onset.filter(F.col("overall_diet") == overall_diet) if overall_diet else onset
    table = feature_table(measurements, eligible(base, cutoffs, crossing, strict), weeks, key=key,
                          keep=("mother", "father", "sex", crossing))
    # siblings are counted in the table they are joined to: write it once
    table = lineage_features(materialize(table), onset, cutoffs, key, crossing).dropna(subset=list(features))
    if exclude_above is not None and "rbg8" in features:
        table = table.filter(F.col("rbg8") < exclude_above)
    return with_label(table, cutoffs, onset=crossing)
