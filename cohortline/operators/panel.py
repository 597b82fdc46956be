"""Long to wide: week pivots of a subject panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivot_weeks(df: DataFrame, key: str, weeks: Sequence[int], measures: Mapping[str, str],
                week: str = "week", strict: bool = True) -> DataFrame:
    """One row per subject, one column per measure and week, named prefix + week.

    ``measures`` maps a column to the prefix of its wide columns. All measures are pivoted in one
    aggregation with partial aggregates before the shuffle. ``strict`` fails when a subject has two
    rows for one week; the check rides on the same aggregation. Subjects with no row in ``weeks``
    are left out, as are other weeks.
    """
    rows = df.filter(F.col(week).isin(*weeks))
    cells = [F.max(F.when(F.col(week) == w, F.col(f"`{m}`"))).alias(f"{prefix}{w}")
             for m, prefix in measures.items() for w in weeks]
    names = [f"{prefix}{w}" for prefix in measures.values() for w in weeks]
    if not strict:
        return rows.groupBy(key).agg(*cells)
    copies = F.greatest(*[F.count_if(F.col(week) == w) for w in weeks], F.lit(0).cast("long"))
    wide = rows.groupBy(key).agg(*cells, copies.alias("_copies"))
    message = F.concat(F.lit(f"duplicate {week} for {key} "), F.col(key).cast("string"))
    checked = F.when(F.col("_copies") > 1, F.raise_error(message).cast(df.schema[key].dataType)).otherwise(F.col(key))
    return wide.select(checked.alias(key), *names)


def stack_pivots(df: DataFrame, key: str, weeks: Sequence[int], measures: Sequence[str],
                 week: str = "week", strict: bool = True) -> DataFrame:
    """The pivots of several measures below each other, labelled in column ``measure``.

    One pivot is computed and unfolded, so the panel is read and shuffled once. Values are text,
    as measures of different types share the columns.
    """
    wide = pivot_weeks(df, key, weeks, {m: f"{m}_" for m in measures}, week, strict)
    parts = [F.struct(F.lit(m).alias("measure"),
                      *[F.col(f"{m}_{w}").cast("string").alias(f"w{w}") for w in weeks]) for m in measures]
    return wide.select(key, F.explode(F.array(*parts)).alias("_r")).select(key, "_r.*")


def wide_export(measurements: DataFrame, subjects: DataFrame, ids: DataFrame, key: str,
                weeks: Sequence[int] = tuple(range(4, 84, 4)), measures: Sequence[str] = ("weight", "rbg", "diet"),
                subject_cols: Sequence[str] = ("birth_date", "rbg200")) -> DataFrame:
    """Subject columns and every measure by week, for the subjects of an id list.

    Text measures are pivoted as numbers and read back after, so that the pivot is a hash aggregate.
    """
    rows = measurements.join(ids.select(key), key, "left_semi")
    rows, texts = _coded(rows.select(key, "week", *measures), measures)
    wide = pivot_weeks(rows, key, weeks, {m: m for m in measures})
    decoded = {f"{m}{w}": F.get(F.array(*[F.lit(t) for t in found]), F.col(f"{m}{w}")) if found else F.lit(None).cast("string")
               for m, found in texts.items() for w in weeks}
    return subjects.select(key, *subject_cols).join(wide.withColumns(decoded) if decoded else wide, key)


CATEGORIES = 1000  # most different texts of a measure that are coded


def _coded(rows: DataFrame, measures: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Text measures as whole numbers in the order of the texts, and the texts of each.

    A maximum of numbers is kept in a hash aggregate, one of texts needs sorted rows. A measure of more than ``CATEGORIES``
    texts stays as it is.
    """
    texts = {}
    for m in measures:
        if rows.schema[m].dataType.simpleString() == "string":
            found = [r[0] for r in rows.select(m).dropna().distinct().limit(CATEGORIES + 1).collect()]  # bounded
            if len(found) <= CATEGORIES:
                texts[m] = sorted(found, key=str.encode)
    codes = {m: F.try_element_at(F.create_map(*[x for i, t in enumerate(found) for x in (F.lit(t), F.lit(i))]), F.col(m))
             if found else F.lit(None).cast("int") for m, found in texts.items()}
    return rows.withColumns(codes) if codes else rows, texts


def pivot_result(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str,
                 fill: float | None = 0.0, carry_forward: str | None = None) -> DataFrame:
    """Pivot of a finished result table with gaps set to ``fill``.

    A zero in a gap makes a cumulative curve drop; ``carry_forward`` names the index column to walk
    along and repeats the last value of the curve instead (gaps before the first value get ``fill``).
    """
    wide = df.groupBy(*index).pivot(column, list(values)).agg(F.max(value))
    names = [str(v) for v in values]
    if carry_forward:
        rest = [c for c in index if c != carry_forward]
        w = Window.partitionBy(*rest).orderBy(carry_forward).rowsBetween(Window.unboundedPreceding, 0)
        wide = wide.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})
    return wide if fill is None else wide.fillna(fill, names)


def first_row(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each group in an explicit order.

    ``row_number() = 1`` is cut down inside every map task before the shuffle, so a large group
    sends one row per task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
