"""Ordered running totals and ranks that never put a large group into one task.

A plain window sorts each partition group in a single task. That is right for a short axis, such as
the week grid of a study. Any other axis (scores, durations) is written once and cut into ranges by its number of rows: every
range gets its own window, and the totals of the ranges before and after it are added from a small aggregate. All sums of
a call, in both directions, share one exchange of the rows and one table of range totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.columns import HASH_SPAN, hash32
from cohortline.session import materialize

RANGES = 256           # of a hash
RANGE_ROWS = 50_000    # aim for one range of an axis
MAX_CUTS = 4095        # cut points of an axis at most; they pass through the driver


def cut_axis(df: DataFrame, order: str, name: str = "_range", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write an aggregated table once and add the range of each row along ``order``.

    The cut points are quantiles, so many that a range has about ``range_rows`` rows; the range of a row is the number
    of cut points below its value. The number of ranges stays with the column, so that a single one needs no table of totals.
    """
    df = materialize(df)
    parts = min(MAX_CUTS + 1, max(1, -(-df.count() // range_rows)))
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 20_000)).first()[0] if parts > 1 else None
    cuts = sorted(set(found or ()))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e < F.col(order))) if cuts else F.lit(0)
    return df.withColumn(name, F.coalesce(below, F.lit(0)).alias(name, metadata={"ranges": len(cuts) + 1}))


def running_totals(df: DataFrame, order: str, sums: Mapping[str, str], by: Sequence[str] = (), descending: bool = False,
                   bounded: bool = False, range_col: str | None = None, rest: Mapping[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums ``{new: column}`` along ``order`` within ``by``, and ``rest``: sums from a row to the end.

    ``df`` holds one row per (``by``, ``order``), so aggregate first. ``bounded=True`` promises a
    short axis and uses a plain window; ``range_col`` names the range column of a table that
    :func:`cut_axis` has cut. With neither, the table is written and cut here.
    """
    by, columns = list(by), df.columns
    rest = dict(rest or {})
    ways = [(new, c, descending) for new, c in sums.items()] + [(new, c, not descending) for new, c in rest.items()]
    direction = lambda name, down: F.col(name).desc() if down else F.col(name).asc()
    upto = lambda keys, name, down, last: Window.partitionBy(*keys).orderBy(direction(name, down)).rowsBetween(
        Window.unboundedPreceding, last)
    if bounded:
        return df.withColumns({new: F.sum(c).over(upto(by, order, down, 0)) for new, c, down in ways})
    if range_col is None:
        range_col = "_range"
        df = cut_axis(df, order, range_col)
    if df.schema[range_col].metadata.get("ranges") == 1:  # nothing lies before or after the only range
        return df.withColumns({new: F.sum(c).over(upto([*by, range_col], order, down, 0)) for new, c, down in ways}).select(
            *columns, *[new for new, _, _ in ways])

    totals = df.groupBy(*by, range_col).agg(*[F.sum(c).alias(f"_t_{new}") for new, c, _ in ways])
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, range_col]],
        *[F.sum(f"_t_{new}").over(upto(by, range_col, down, -1)).alias(f"_o_{new}") for new, _, down in ways])
    local = df.withColumns({new: F.sum(c).over(upto([*by, range_col], order, down, 0)) for new, c, down in ways})
    on = F.lit(True)
    for c in [*by, range_col]:
        on = on & local[c].eqNullSafe(offsets[f"_k_{c}"])
    return local.join(offsets, on).select(
        *columns, *[(F.col(new) + F.coalesce(F.col(f"_o_{new}"), F.lit(0))).alias(new) for new, _, _ in ways])


def previous(df: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = (), range_col: str = "_range") -> DataFrame:
    """Add ``_previous_<column>``, the values of the row before along ``order``, to a table that :func:`cut_axis` has cut.

    The first row of a range takes the last one of the range before it, found in a table of a row for each range.
    """
    by = list(by)
    inside = Window.partitionBy(*by, range_col).orderBy(order)
    row = F.struct(*columns)
    last = df.groupBy(*by, range_col).agg(F.max_by(row, order).alias("_last"))
    last = last.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, range_col]],
                       F.lag("_last").over(Window.partitionBy(*by).orderBy(range_col)).alias("_before"))
    local = df.withColumn("_inside", F.lag(row).over(inside))
    on = F.lit(True)
    for c in [*by, range_col]:
        on = on & local[c].eqNullSafe(last[f"_k_{c}"])
    found = F.coalesce("_inside", "_before")
    return local.join(last, on).select(*df.columns, *[found[c].alias(f"_previous_{c}") for c in columns])


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "rank",
              ranges: int = RANGES) -> DataFrame:
    """Number the rows of each ``by`` group 0, 1, 2, ... in the order of a stable hash of the key.

    The hash itself spreads rows evenly, so its leading bits cut each group into ``ranges`` equal ranges. The rows are
    written once: counts and ranks are read from the copy.
    """
    by = list(by)
    cut = materialize(df.withColumn("_hash", hash32(key, seed))
                      .withColumn("_range", F.floor(F.col("_hash") / (HASH_SPAN // ranges)).cast("int")))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
               .select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_range"]],
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*by, "_range").orderBy("_hash", key)
    local = cut.withColumn("_rn", F.row_number().over(inside) - 1)
    on = F.lit(True)
    for c in [*by, "_range"]:
        on = on & local[c].eqNullSafe(offsets[f"_k_{c}"])
    return (local.join(offsets, on)
            .select(*[F.col(c) for c in df.columns], (F.col("_offset") + F.col("_rn")).alias(name)))
