"""Features from parent and sibling links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import any_flag, by_sex


NULL_SPREAD = 256


def _left_join_parent(df: DataFrame, side: DataFrame, parent: str, side_key: str, key: str) -> DataFrame:
    """Left join on a parent id that is often unknown.

    A left join sends all null keys to one task. A second join key, 0 on the parent side, spreads the
    rows with an unknown parent by their own key; they match nothing either way. (``pmod(.., 1)`` is
    a 0 that the optimizer does not fold away.)
    """
    spread = F.when(F.col(parent).isNull(), F.pmod(F.xxhash64(key), F.lit(NULL_SPREAD))).otherwise(F.lit(0))
    left = df.withColumn("_spread", spread.cast("long"))
    right = side.withColumn("_zero", F.pmod(F.xxhash64(side_key), F.lit(1)).cast("long"))
    on = (left[parent] == right[side_key]) & (left["_spread"] == right["_zero"])
    return left.join(right, on, "left").drop("_spread", "_zero", side_key)


def parent_onset(df: DataFrame, onset_df: DataFrame, key: str = "subject_id", onset: str = "rbg200",
                 mother: str = "mother", father: str = "father") -> DataFrame:
    """Crossing week of each parent; null for a parent that is unknown or not in the table."""
    for parent, suffix in ((mother, "mo"), (father, "fa")):
        side = onset_df.select(F.col(key).alias(f"_{suffix}"), F.col(onset).alias(f"{onset}_{suffix}"))
        df = _left_join_parent(df, side, parent, f"_{suffix}", key)
    return df


def own_onset(cutoffs: Mapping[str, int], onset: str = "rbg200", sex: str = "sex"):
    """True when the subject crossed by its sex's cutoff."""
    return F.coalesce(F.col(onset) <= by_sex(sex, cutoffs), F.lit(False))


def sibling_onset(df: DataFrame, cutoffs: Mapping[str, int], onset: str = "rbg200", mother: str = "mother",
                  name: str = "rbg200_sib", key: str = "subject_id") -> DataFrame:
    """1 when another child of the same mother in the table has onset, else 0.

    Children are counted per mother (partial counts before the shuffle) and joined back, so a
    mother with very many children is a skewed join, which Spark splits, and not one huge window.
    Subjects with no recorded mother have no siblings.
    """
    flagged = df.withColumn("_own", own_onset(cutoffs, onset).cast("int"))
    family = (flagged.filter(F.col(mother).isNotNull()).groupBy(F.col(mother).alias("_mother"))
              .agg(F.sum("_own").alias("_family")))
    out = _left_join_parent(flagged, family, mother, "_mother", key)
    others = F.coalesce(F.col("_family") - F.col("_own"), F.lit(0)) > 0
    return out.withColumn(name, others.cast("int")).drop("_own", "_family")


def family_history(df: DataFrame, cutoffs: Mapping[str, int], onset: str = "rbg200",
                   name: str = "family_history") -> DataFrame:
    """Parents' flags by cutoff (father by the male, mother by the female one) and the OR of all three."""
    fa = F.coalesce(F.col(f"{onset}_fa") <= cutoffs["M"], F.lit(False))
    mo = F.coalesce(F.col(f"{onset}_mo") <= cutoffs["F"], F.lit(False))
    return (df.withColumns({f"{onset}_fa": fa, f"{onset}_mo": mo})
            .withColumn(name, any_flag(F.col(f"{onset}_fa"), F.col(f"{onset}_mo"), F.col(f"{onset}_sib"))))


def lineage_features(df: DataFrame, onset_df: DataFrame, cutoffs: Mapping[str, int], key: str = "subject_id",
                     onset: str = "rbg200") -> DataFrame:
    """Parent, sibling and family flags. Siblings are counted within ``df``, parents in ``onset_df``."""
    out = sibling_onset(parent_onset(df, onset_df, key, onset), cutoffs, onset, name=f"{onset}_sib",
                        key=key)
    return family_history(out, cutoffs, onset)
