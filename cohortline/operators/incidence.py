"""Cumulative incidence of onset and the bands around survival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.columns import NEVER, censor
from cohortline.operators.onset import cohort, followed_up
from cohortline.operators.panel import pivot_result
from cohortline.operators.running import running_totals


def cumulative_incidence(df: DataFrame, by: Sequence[str] = ("sex",), week: str = "rbg200",
                         limit: int | None = 40, never: int = NEVER) -> DataFrame:
    """Count, running count and percent of the group by onset week.

    Onset after ``limit`` counts as never. Subjects are reduced to one row per group and week
    before any ordering, so the windows see only the week grid.
    """
    by = list(by)
    if limit is not None:
        df = df.withColumn(week, censor(week, limit, never))
    counts = df.groupBy(*by, week).agg(F.count(F.lit(1)).alias("count"))
    out = running_totals(counts, week, {"cumulative": "count"}, by, bounded=True)
    total = F.max("cumulative").over(Window.partitionBy(*by))
    return out.withColumn("percent", F.col("cumulative") / total * 100)


def maternal_diet_cohort(onset: DataFrame, diet: str, weeks: int = 40) -> DataFrame:
    """Weaned and kept on regular chow, with the given maternal diet, and followed up to ``weeks``."""
    kept = cohort(onset, overall_diet="Rod", weanling_diet="Rod", nursing_diet=diet, gestational_diet=diet)
    return followed_up(kept, weeks)


def incidence_by_diet(onset: DataFrame, diets: Sequence[str] = ("Rod", "Rab"), weeks: int = 40,
                      drop_week: int | None = 4) -> DataFrame:
    """Incidence by sex and maternal diet; the first week is left out of the report.

    Both cohorts come from one pass: the group is a key of the aggregation instead of a union of
    two scans.
    """
    kept = cohort(onset, overall_diet="Rod", weanling_diet="Rod", nursing_diet=list(diets))
    kept = kept.filter(F.col("gestational_diet") == F.col("nursing_diet"))
    out = (cumulative_incidence(followed_up(kept, weeks), ("sex", "nursing_diet"), limit=weeks)
           .withColumnRenamed("nursing_diet", "nursing"))
    return out if drop_week is None else out.filter(F.col("rbg200") != drop_week)


def incidence_pivot(incidence: DataFrame, diets: Sequence[str] = ("Rod", "Rab"),
                    carry_forward: bool = False) -> DataFrame:
    """One row per sex and week, percent by diet; a diet without onsets that week reads 0."""
    return pivot_result(incidence, ("sex", "rbg200"), "nursing", diets, "percent",
                        carry_forward="rbg200" if carry_forward else None)


def survival_percent(pivot: DataFrame, diets: Sequence[str] = ("Rod", "Rab"), never: int = NEVER) -> DataFrame:
    """Percent still free of onset; the never-crossed row is not a point in time."""
    return (pivot.filter(F.col("rbg200") != never)
            .withColumns({d: F.lit(100.0) - F.col(d) for d in diets}))


def binomial_band(survival: DataFrame, sizes: DataFrame, diets: Sequence[str] = ("Rod", "Rab"),
                  by: str = "sex", n: str = "n", z: float = 1.96) -> DataFrame:
    """Percent with p +- z sqrt(p (100 - p) / n), in long form.

    ``sizes`` gives n per group of ``by``: all subjects of the sex, both diets pooled.
    """
    rows = survival.join(sizes.select(by, n), by).unpivot(
        [by, "rbg200", n], list(diets), "nursing", "percent_free")
    half = F.lit(z) * F.sqrt(F.col("percent_free") * (F.lit(100.0) - F.col("percent_free")) / F.col(n))
    return rows.withColumns({"lower": F.col("percent_free") - half, "upper": F.col("percent_free") + half})
