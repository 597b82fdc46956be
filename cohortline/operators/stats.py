"""Group statistics: Welch tests, growth, correlations, quantiles, histograms and densities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.tails import with_p_value
from cohortline.operators.panel import pivot_weeks
from cohortline.operators.running import cut_axis, running_totals
from cohortline.session import materialize


def group_counts(df: DataFrame, key: str, value: str, by: Sequence[str]) -> DataFrame:
    """Subjects and non-null values per group.

    Reduced to one row per subject first, so the distinct count is a plain count afterwards.
    """
    per_subject = df.groupBy(*by, key).agg(F.count(value).alias("_n"))
    return per_subject.groupBy(*by).agg(F.count(key).alias("n_subjects"), F.sum("_n").alias("n_values"))


def welch_ttest(df: DataFrame, value: str, group: str, levels: Sequence, by: Sequence[str] = (),
                p: bool = True) -> DataFrame:
    """Welch's t, degrees of freedom and p for two groups, one row per ``by``.

    Moments of both groups come from one aggregation. Undefined cases (fewer than two values, no
    variance) give nulls.
    """
    a, b = (F.when(F.col(group) == lv, F.col(value)) for lv in levels)
    m = df.groupBy(*by).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v2"))
    s1, s2 = F.try_divide("_v1", "n1"), F.try_divide("_v2", "n2")
    spread = (F.try_divide(s1 * s1, F.col("n1") - 1) + F.try_divide(s2 * s2, F.col("n2") - 1))
    out = (m.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2)))
           .withColumn("df", F.try_divide((s1 + s2) * (s1 + s2), spread)).drop("_v1", "_v2"))
    return with_p_value(out, "t", "t", "df") if p else out


def growth(measurements: DataFrame, key: str = "subject_id", value: str = "weight", start: int = 4, end: int = 8,
           base: int | None = None) -> DataFrame:
    """Percent growth between two weeks for subjects with both values.

    The denominator is the later week unless ``base`` says otherwise; a zero base gives 0.
    """
    base = end if base is None else base
    wide = pivot_weeks(measurements.filter(F.col(value).isNotNull()), key, (start, end), {value: "_w"})
    wide = wide.dropna(subset=[f"_w{start}", f"_w{end}"])
    change = F.try_divide(F.col(f"_w{end}") - F.col(f"_w{start}"), F.col(f"_w{base}")) * 100
    return wide.select(key, F.col(f"_w{start}").alias(f"{value}{start}"), F.col(f"_w{end}").alias(f"{value}{end}"),
                       F.coalesce(change, F.lit(0.0)).alias("percent_increase"))


def _numbered_groups(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the number ``_gid`` of each row's group, and the written table of groups."""
    if not by:
        return df.withColumn("_gid", F.lit(0).cast("long")), df.sparkSession.range(1).withColumnRenamed("id", "_gid")
    groups = materialize(df.select(*by).distinct().withColumn("_gid", F.monotonically_increasing_id()))
    return _join_by(df, groups, by), groups


MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab")
GROUPS_HELD = 256  # groups whose moments a task holds before it passes them on


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form, per group; null for a constant column.

    The moments of all pairs of columns are products of matrices: each task multiplies its batches and passes on one row for
    each pair and group, whatever its number of rows. Columns are shifted by their means first, so that the
    moments are of the size of the spread; what is left of a variance below 1e-12 of its terms counts as none.
    """
    by, cols, p = list(by), list(cols), len(cols)
    rows, groups = _numbered_groups(df, by)
    numbers = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    center = np.array([m or 0.0 for m in df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in cols]).first()])
    first, second = np.triu_indices(p)

    def moments(batches):
        held: dict[int, np.ndarray] = {}

        def out():
            for g, t in held.items():
                yield pd.DataFrame({"_gid": g, "_i": first.astype("int32"), "_j": second.astype("int32"),
                                    **dict(zip(MOMENTS, t[:, first, second], strict=True))})
            held.clear()

        for pdf in batches:
            for g, part in pdf.groupby("_gid", sort=False):
                x = part[[f"x{i}" for i in range(p)]].to_numpy(float) - center
                known = ~np.isnan(x)
                x, known = np.where(known, x, 0.0), known.astype(float)
                sums = x.T @ known
                squares = (x * x).T @ known
                held[g] = held.get(g, 0.0) + np.stack([known.T @ known, sums, sums.T, squares, squares.T, x.T @ x])
            if len(held) > GROUPS_HELD:
                yield from out()
        yield from out()

    part = rows.select("_gid", *numbers).mapInPandas(moments, "_gid long, _i int, _j int, " + ", ".join(f"{m} double" for m in MOMENTS))
    t = part.groupBy("_gid", "_i", "_j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    spread = lambda q, s: F.when(F.col(q) - F.col(s) * F.col(s) / F.col("n") > F.col(q) * 1e-12,
                                 F.col(q) - F.col(s) * F.col(s) / F.col("n"))
    t = t.withColumn("n", F.when(F.col("n") > 0, F.col("n")))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread("saa", "sa") * spread("sbb", "sb"))
    both = F.when(F.col("_i") == F.col("_j"), F.array(F.struct("_i", "_j"))).otherwise(
        F.array(F.struct("_i", "_j"), F.struct(F.col("_j").alias("_i"), F.col("_i").alias("_j"))))
    names = F.lit(cols)
    pairs = t.select("_gid", r.alias("r"), F.explode(both).alias("_p")).select(
        "_gid", names[F.col("_p._i")].alias("x"), names[F.col("_p._j")].alias("y"), "r")
    return pairs.join(groups, "_gid").select(*by, "x", "y", "r")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of rows of each distinct non-null value per group."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Distinct values are counted and ranked by distributed running totals; each quantile is then the
    value at one or two ranks, found by a conditional minimum. No group is sorted in one task.
    """
    by = list(by)
    return _count_quantiles(cut_axis(value_counts(df, value, by), value), value, probs, by)


def _count_quantiles(counts: DataFrame, value: str, probs: dict[str, float],
                     by: list[str]) -> DataFrame:
    """Quantiles of a table of distinct values with their counts and ranges."""
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    ranked = running_totals(counts, value, {"_upto": "n"}, by, range_col="_range")
    joined = _join_by(ranked, sizes, by)
    low = {k: F.floor((F.col("_size") - 1) * F.lit(q)) for k, q in probs.items()}
    aggs = [F.max("_size").alias("n")]
    for k in probs:
        aggs.append(F.min(F.when(F.col("_upto") > low[k], F.col(value))).alias(f"_lo_{k}"))
        aggs.append(F.min(F.when(F.col("_upto") > low[k] + 1, F.col(value))).alias(f"_hi_{k}"))
    out = joined.groupBy(*by).agg(*aggs)
    cols = []
    for k, q in probs.items():
        h = (F.col("n") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo_{k}"), F.coalesce(F.col(f"_hi_{k}"), F.col(f"_lo_{k}"))
        cols.append((lo + (h - F.floor(h)) * (hi - lo)).alias(k))
    return out.select(*by, "n", *cols)


def _join_by(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-group totals; without groups the totals are a single row."""
    if by:
        right = small.select(*[F.col(c).alias(f"_j_{c}") for c in by], *[c for c in small.columns if c not in by])
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        return df.join(right, on).drop(*[f"_j_{c}" for c in by])
    row = small.select(F.struct("*").alias("_t")).scalar()
    return df.withColumn("_t", row).select(*df.columns, "_t.*")


def box_summary(df: DataFrame, value: str, by: Sequence[str] = (), whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR of the box, and outliers beyond."""
    by = list(by)
    counts = cut_axis(value_counts(df, value, by), value)
    q = _count_quantiles(counts, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    counts = _join_by(counts.withColumnRenamed("n", "_n"), q.drop("n"), by)
    span = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - span) & (F.col(value) <= F.col("q3") + span)
    return counts.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.min(value).alias("min"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"), F.max(value).alias("max"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"))


def outliers(df: DataFrame, value: str, by: Sequence[str] = (), whisker: float = 1.5) -> DataFrame:
    """The rows whose value lies beyond the whiskers of its group."""
    by = list(by)
    q = exact_quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, by).drop("n")
    span = F.lit(whisker) * (F.col("_q3") - F.col("_q1"))
    beyond = (F.col(value) < F.col("_q1") - span) | (F.col(value) > F.col("_q3") + span)
    return _join_by(df, q, by).filter(beyond).select(*df.columns)


def approx_box(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    """Quartiles from one pass of mergeable sketches, where exact ones are not needed."""
    q = F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy)
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), q.alias("_q"),
                              F.max(value).alias("max"))
    return out.select(*by, "n", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                      F.col("_q")[2].alias("q3"), "max")


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), width: float = 10.0) -> DataFrame:
    """Density histogram per group on bins common to all groups; the last edge is closed.

    Density integrates to one within each group. Empty bins are not listed.
    """
    by = list(by)
    counts = materialize(value_counts(df, value, by))
    ends = counts.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    placed = _join_by(counts, ends, [])
    offset = F.col(value) - F.col("_min")
    last = F.greatest(F.ceil((F.col("_max") - F.col("_min")) / width) - 1, F.lit(0))
    binned = (placed.withColumn("bin", F.least(F.floor(offset / width), last).cast("int"))
              .groupBy(*by, "bin").agg(F.sum("n").alias("count"), F.max("_min").alias("_min")))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    out = _join_by(binned, sizes, by)
    left = F.col("_min") + F.col("bin") * F.lit(float(width))
    return out.select(*by, "bin", left.alias("left_edge"), "count",
                      (F.col("count") / (F.col("_size") * F.lit(float(width)))).alias("density"))


def kde(df: DataFrame, value: str, by: Sequence[str] = (), grid: int = 200) -> DataFrame:
    """Gaussian kernel density per group on an even grid over the range of all data.

    Scott's bandwidth per group; a group of one value, or without spread, has no bandwidth and null density. Rows are reduced to distinct values with counts; each task
    adds their kernels to the points of the grid as arrays and passes on one array for each group.
    """
    by = list(by)
    counts, groups = _numbered_groups(materialize(value_counts(df, value, by)), by)
    mean = counts.groupBy("_gid").agg(F.sum("n").alias("_size"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("_mean"))
    gap = F.col(value) - F.col("_mean")
    stats = counts.join(mean, "_gid").groupBy("_gid").agg(
        F.max("_size").alias("_size"), F.sqrt(F.try_divide(F.sum(F.col("n") * gap * gap), F.max("_size") - 1)).alias("_sd"))
    stats = materialize(stats.select("_gid", F.when(F.col("_sd") > 0, F.col("_sd") * F.pow(F.col("_size"), F.lit(-0.2))).alias("_h"), "_size"))
    low, high = counts.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low is None:
        return groups.select(*by, F.lit(0).alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    points = low + (high - low) * np.arange(grid) / (grid - 1)

    def kernels(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("_gid", sort=False):
                v, n = part["v"].to_numpy(float), part["n"].to_numpy(float)
                h = float(part["h"].iloc[0])
                for a in range(0, len(v), 4096):
                    u = (points[:, None] - v[None, a:a + 4096]) / h
                    held[g] = held.get(g, 0.0) + np.exp(-0.5 * u * u) @ n[a:a + 4096]
            if len(held) > GROUPS_HELD:
                yield pd.DataFrame({"_gid": list(held), "_sums": list(held.values())})
                held.clear()
        yield pd.DataFrame({"_gid": list(held), "_sums": list(held.values())})

    spread = counts.join(stats.where("_h IS NOT NULL"), "_gid").select("_gid", F.col(value).cast("double").alias("v"), "n", F.col("_h").alias("h"))
    part = spread.mapInPandas(kernels, "_gid long, _sums array<double>")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array_repeat(F.lit(0.0), grid)
    sums = part.groupBy("_gid").agg(F.aggregate(F.collect_list("_sums"), zero, add).alias("_sums"))  # a row for each task
    at = F.posexplode(F.coalesce("_sums", F.array_repeat(F.lit(None).cast("double"), grid))).alias("point", "_sum")
    density = F.col("_sum") / (F.col("_size") * F.col("_h") * F.sqrt(2 * F.pi()))
    x = F.lit(low) + F.lit(high - low) * F.col("point") / F.lit(grid - 1)
    return (stats.join(sums, "_gid", "left").select("_gid", "_size", "_h", at)
            .join(groups, "_gid").select(*by, "point", x.alias("x"), density.alias("density")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that occur in both groups."""
    return a.select(key).intersect(b.select(key))
