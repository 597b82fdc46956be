"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.catalog.views import PANEL_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, as the order of addition differs between engines; no negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function ``(spark, sf_dir) -> DataFrame``.

    ``sql`` may use the panel views ``fx_measurement``, ``fx_main``, ``fx_onset``, ``fx_wide``, and
    may start with further CTEs after ``WITH``.
    """

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            text = sql.strip()
            if text[:15].upper() == "WITH RECURSIVE ":
                ORACLES[name] = f"WITH RECURSIVE {PANEL_SQL},\n{text[15:]}"
            elif text[:5].upper() == "WITH ":
                ORACLES[name] = f"WITH {PANEL_SQL},\n{text[5:]}"
            else:
                ORACLES[name] = f"WITH {PANEL_SQL}\n{text}"
        return fn

    return add
