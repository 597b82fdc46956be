"""Cleaning of the study tables: typing, grid, corrections, duplicates, complete rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import cast_text, coerce_numeric, parse_dates

SMALL_TABLE_ROWS = 10_000  # a correction list typed in by hand may be broadcast up to this size

# Corrections of mistyped weeks by measurement id, and ids to delete.
WEEK_CORRECTIONS = {56925: 16, 56926: 16, 56277: 38, 56280: 38, 56367: 38}
DELETED_MEASUREMENTS = (56035, 56472)

# Column types of the cleaned study tables.
MEASUREMENT_TYPES = {"weight": "double", "rbg": "double", "weight percentile": "double",
                     "pregnant_days": "long"}
BREEDING_TYPES = {
    "d0_count": "long", "d7_count": "long", "d14_count": "long", "d21_count": "long",
    "d0_weight": "double", "d7_weight": "double", "d14_weight": "double", "d21_weight": "double",
    "maternal_onset": "long", "paternal_onset": "long"}
BREEDING_DATES = ("mating_date", "pups_born", "weaned_date", "d0_date", "d7_date", "d14_date", "d21_date")


def on_grid(df: DataFrame, step: int = 4, week: str = "week") -> DataFrame:
    """Rows measured on the study's week grid."""
    return df.filter(F.col(week) % step == 0)


def clean_subjects(df: DataFrame) -> DataFrame:
    return parse_dates(df, ("birth_date", "death_date"))


def clean_measurements(df: DataFrame, step: int = 4) -> DataFrame:
    """Grid weeks only, typed dates, text notes, whole numbers in the readings."""
    df = parse_dates(on_grid(df, step), ("expected_date", "actual_date"))
    text = [c for c in ("measurement_notes", "next_diet") if c in df.columns]
    return coerce_numeric(cast_text(df, text), MEASUREMENT_TYPES)


def clean_breeding(df: DataFrame) -> DataFrame:
    df = parse_dates(df, BREEDING_DATES)
    return coerce_numeric(cast_text(df, [c for c in ("notes",) if c in df.columns]), BREEDING_TYPES)


def litter_readings(breeding: DataFrame, start: int = 10, stop: int = 22) -> DataFrame:
    """The litter-reading block of the breeding table, without rows that hold nothing."""
    return breeding.select(*[F.col(f"`{c}`") for c in breeding.columns[start:stop]]).dropna("all")


def apply_corrections(df: DataFrame, fixes: Mapping[int, int] | DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where the row's key has a correction.

    ``fixes`` is a dict, or a table with the key and the corrected column, in which the largest of several
    corrections of a key counts. A hand-made list is small enough to broadcast; a table is left to the optimizer, which
    knows its size.
    """
    if isinstance(fixes, DataFrame):
        patch = fixes.groupBy(key).agg(F.max(column).alias("_fix"))
    else:
        spark = df.sparkSession
        types = f"`{key}` {df.schema[key].dataType.simpleString()}, _fix {df.schema[column].dataType.simpleString()}"
        patch = spark.createDataFrame(list(fixes.items()), types)
        if len(fixes) <= SMALL_TABLE_ROWS:
            patch = F.broadcast(patch)
    out = df.join(patch, key, "left").withColumn(column, F.coalesce(F.col("_fix"), F.col(column)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def drop_keys(df: DataFrame, ids: Sequence | DataFrame, key: str) -> DataFrame:
    """Delete the rows with these keys."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_anti")
    return df.filter(~F.coalesce(F.col(key).isin(*ids), F.lit(False)))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id list."""
    return df.join(ids.select(key), key, "left_semi")


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key combination, in which null equals null, occurs more than once.

    Keys are counted first (partial counts before the shuffle) and joined back as a semi-join, so a
    key with very many copies is split by the adaptive skew join instead of filling one window.
    """
    keys = list(keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = repeated.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(repeated[f"_k_{k}"]) for k in keys])
    return df.join(repeated, on, "left_semi")


def complete_weeks(df: DataFrame, cols: Sequence[str], below: Mapping[str, float] | None = None) -> DataFrame:
    """Rows with a positive value in every column, and below a limit where one is given."""
    keep: Column = F.lit(True)
    for c in cols:
        keep = keep & (F.col(c) > 0)
    for c, limit in (below or {}).items():
        keep = keep & (F.col(c) < limit)
    return df.filter(keep)


def min_observations(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """Rows of subjects that have at least ``n`` rows."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(key)
    return df.join(enough, key, "left_semi")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of nulls in each column, one row per column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "n_null")
