"""First-crossing weeks, cohorts and event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import NEVER, by_sex, lived_at_least

THRESHOLDS = (100, 120, 200, 300)


def first_crossings(df: DataFrame, key: str = "subject_id", week: str = "week", value: str = "rbg",
                    thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Least week with a reading above each threshold; null where there is none.

    One pass and one shuffle for all thresholds: conditional minima with partial aggregation.
    """
    return df.groupBy(key).agg(*[
        F.min(F.when(F.col(value) > t, F.col(week))).alias(f"{value}{t}") for t in thresholds])


def onset_table(subjects: DataFrame, measurements: DataFrame, key: str = "subject_id", week: str = "week",
                value: str = "rbg", thresholds: Sequence[float] = THRESHOLDS, never: int = NEVER) -> DataFrame:
    """Every subject with its crossing weeks, ``never`` where a threshold was not crossed."""
    crossed = first_crossings(measurements, key, week, value, thresholds)
    names = [f"{value}{t}" for t in thresholds]
    return subjects.join(crossed, key, "left").fillna(never, names)


def first_reading_above(df: DataFrame, threshold: float, key: str = "subject_id", week: str = "week",
                        value: str = "rbg") -> DataFrame:
    """The whole row of the earliest reading above a threshold, per subject."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    best = F.min_by(row, F.col(week)).alias("_row")
    return df.filter(F.col(value) > threshold).groupBy(key).agg(best).select(key, "_row.*")


def cohort(df: DataFrame, **diets: str | Sequence[str]) -> DataFrame:
    """Subjects with the given diet history, e.g. ``cohort(onset, overall_diet="Rod")``."""
    for column, values in diets.items():
        values = [values] if isinstance(values, str) else list(values)
        df = df.filter(F.col(column).isin(*values))
    return df


def followed_up(df: DataFrame, weeks: int = 40, onset: str = "rbg200") -> DataFrame:
    """Subjects that lived to the week, or crossed by then."""
    return df.filter(lived_at_least(7 * weeks) | (F.col(onset) <= weeks))


def onset_group(cutoffs: Mapping[str, int], onset: str = "rbg200", sex: str = "sex") -> Column:
    """``onset`` if crossed by the sex's cutoff, ``no onset`` if known to have lived to it without, else null."""
    limit = by_sex(sex, cutoffs)
    return (F.when(F.col(onset) <= limit, "onset")
            .when(lived_at_least(7 * limit) & (F.col(onset) > limit), "no onset"))


def onset_groups(df: DataFrame, cutoffs: Mapping[str, int], onset: str = "rbg200") -> DataFrame:
    return df.withColumn("onset_group", onset_group(cutoffs, onset)).filter(F.col("onset_group").isNotNull())


def eligible(df: DataFrame, cutoffs: Mapping[str, int], onset: str = "rbg200", strict: bool = True,
             never: int = NEVER) -> DataFrame:
    """Subjects whose label is known at the cutoff.

    ``strict`` keeps those that lived to their cutoff or crossed by it. Otherwise any recorded
    crossing week counts, and as never-crossed is stored as a week too, everyone with a known
    sex passes; that is what the original study code does.
    """
    limit = by_sex("sex", cutoffs)
    if strict:
        return df.filter(lived_at_least(7 * limit) | F.coalesce(F.col(onset) <= limit, F.lit(False)))
    return df.filter(lived_at_least(7 * limit) | F.coalesce(F.col(onset) > 0, F.lit(False)))


def last_week(measurements: DataFrame, key: str = "subject_id", week: str = "week") -> DataFrame:
    return measurements.groupBy(key).agg(F.max(week).alias("last_week"))


def event_table(onset_df: DataFrame, measurements: DataFrame, key: str = "subject_id", onset: str = "rbg200",
                shift: int = 4, never: int = NEVER, keep: Sequence[str] = ("sex",)) -> DataFrame:
    """Event flag and time for survival models.

    Time is the crossing week; else the lifetime in weeks, rounded half-even; else, with no death
    date, the last measured week; all counted from week ``shift``.
    """
    lifetime = F.bround(F.datediff("death_date", "birth_date") / 7 - shift, 0).cast("int")
    joined = onset_df.join(last_week(measurements, key), key, "left")
    crossed = F.col(onset) < never
    time = F.when(crossed, F.col(onset) - shift).otherwise(F.coalesce(lifetime, F.col("last_week") - shift))
    return joined.select(key, *keep, crossed.cast("int").alias("event"), time.cast("int").alias("event_time"))


def longitudinal_events(measurements: DataFrame, events: DataFrame, key: str = "subject_id", shift: int = 4,
                        cols: Sequence[str] = ("weight", "rbg", "diet")) -> DataFrame:
    """The panel with its subject's event columns; weeks counted from ``shift``."""
    rows = measurements.select(key, (F.col("week") - shift).alias("week"), *cols)
    return rows.join(events, key)


def cox_input(onset_df: DataFrame, limit: int = 40, onset: str = "rbg200", diet: str = "nursing_diet",
              codes: Mapping[str, int] | None = None, key: str = "subject_id",
              never: int = NEVER) -> DataFrame:
    """Duration and event with follow-up cut at ``limit``, and the diet as a number."""
    codes = codes or {"Rab": 1, "Rod": 0}
    value = None
    for k, v in codes.items():
        value = F.when(F.col(diet) == k, v) if value is None else value.when(F.col(diet) == k, v)
    event = F.col(onset) <= limit
    return onset_df.select(
        key, "sex", F.when(event, F.col(onset)).otherwise(never).alias(onset), value.alias("diet"),
        event.cast("int").alias("event"), F.when(event, F.col(onset)).otherwise(limit).alias("duration"))


def onset_counts_by(onset_df: DataFrame, week: int, by: str, onset: str = "rbg200") -> DataFrame:
    """Number of subjects with onset exactly in a week, by group."""
    return onset_df.filter(F.col(onset) == week).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
