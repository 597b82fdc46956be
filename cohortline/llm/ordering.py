"""Running sums along an order of any length, without a window over all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import materialize


def sums_before(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of a column over all rows earlier in ``order``.

    Rows are dealt into ranges of the order and written with the number of their range; each range has a window of its own,
    and the totals of the ranges before it, a row for each range, are added. Rows that tie in ``order`` come one after another.
    """
    part, local = "__range", {name: f"__sum_{name}" for name in sums}
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(local[name]) for name, c in sums.items()])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select(F.col(part).alias("__of"), *[F.coalesce(F.sum(local[name]).over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({local[name]: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    return summed.join(F.broadcast(offsets), F.col(part) == F.col("__of")).select(
        *df.columns, *[(F.col(local[name]) + F.col(f"__before_{name}")).alias(name) for name in sums])
