"""Train/test splits and folds from stable hashes.

The assignment depends on the key and the seed only, so it does not change with partitioning,
retries or engine, and two jobs agree on it without sharing data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import HASH_SPAN, hash32
from cohortline.operators.running import hash_rank

SPLIT_SEED = 888
FOLD_SEED = 42


def split_flag(df: DataFrame, key: str, test: float = 0.2, seed: int = SPLIT_SEED, name: str = "is_test") -> DataFrame:
    """Flag about ``test`` of the keys for the hold-out set."""
    return df.withColumn(name, hash32(key, seed) < int(test * HASH_SPAN))


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: disjoint, complete and the same on every run."""
    flagged = split_flag(df, key, test, seed, "_test")
    return flagged.filter(~F.col("_test")).drop("_test"), flagged.filter("_test").drop("_test")


def fold_by_subject(df: DataFrame, key: str, k: int = 5, seed: int = FOLD_SEED, name: str = "fold") -> DataFrame:
    """Fold number of each row by its subject's hash: all rows of a subject fall together."""
    return df.withColumn(name, F.pmod(hash32(key, seed), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = FOLD_SEED,
                     name: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """Folds whose class counts differ by at most one, for one row per key."""
    ranked = hash_rank(df, key, seed, [*by, label], "_rank")
    return ranked.withColumn(name, (F.col("_rank") % k).cast("int")).drop("_rank")
