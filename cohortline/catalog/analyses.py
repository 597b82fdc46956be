"""The study's analyses end to end: from exported tables of text columns, made of the given tables, to results.

The readings are those of the panel views with some noise that cleaning must remove: fractions to round, missing values written
as text, rows off the week grid, days with a two-digit year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query
from cohortline.catalog.statistics import _T_TAIL, _WELCH, _WELCH_OUT
from cohortline.catalog.views import measurements, subjects, table
from cohortline.operators.clean import clean_breeding, litter_readings
from cohortline.plans import reports
from cohortline.plans.features import feature_table
from cohortline.session import materialize
from cohortline.sources.tables import BREEDING_SCHEMA, MEASUREMENT_SCHEMA, SUBJECT_SCHEMA

_DAY = "M/d/yy H:mm:ss"


def _text(day: str):
    return F.date_format(day, _DAY)


def _shaped(df, schema):
    """All columns of an exported table, in its order; those not made here are empty."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def exported(spark, d):
    """The subject and the measurement table as the study exports them."""
    main = subjects(spark, d).withColumns({"NR_Name": F.col("subject_id").cast("string"), "birth_date": _text("birth_date"), "death_date": _text("death_date")})
    text = lambda c: F.coalesce(F.concat(F.col(c).cast("long").cast("string"), F.lit(".25")), F.lit("n/a"))
    rows = materialize(measurements(spark, d)).select(
        F.col("measurement_id").alias("measurement_ID"), F.col("subject_id").cast("string").alias("NR_Name"), "week", text("weight").alias("weight"),
        text("rbg").alias("rbg"), F.concat((F.col("weight") * 2).cast("long").cast("string"), F.lit(".5")).alias("weight percentile"), "diet")
    off_grid = rows.withColumns({"week": F.col("week") + 1, "rbg": F.lit("999")})
    return _shaped(main, SUBJECT_SCHEMA), _shaped(rows.unionByName(off_grid), MEASUREMENT_SCHEMA)


def _study(spark, d):
    readings, onset = reports.load_study(*exported(spark, d))
    return readings, materialize(onset)


@query("analysis_load_study", """
SELECT CAST(subject_id AS VARCHAR) AS "NR_Name", sex, birth_date, death_date, rbg100, rbg120, rbg200, rbg300 FROM fx_onset""")
def load(spark, d):
    return _study(spark, d)[1].select("NR_Name", "sex", "birth_date", "death_date", "rbg100", "rbg120", "rbg200", "rbg300")


_CUTS = {"M": 4, "F": 8}
_GROUPED = """
grp AS (SELECT subject_id, sex, CASE WHEN rbg200 <= cut THEN 'onset' ELSE 'no onset' END AS onset_group
  FROM (SELECT *, CASE sex WHEN 'M' THEN 4 ELSE 8 END AS cut FROM fx_onset
        WHERE overall_diet = 'Rod' AND weanling_diet = 'Rod' AND nursing_diet = 'Rod')
  WHERE rbg200 <= cut OR date_diff('day', birth_date, death_date) >= 7 * cut),
gw AS (SELECT subject_id, week, weight, sex, onset_group FROM fx_measurement JOIN grp USING (subject_id)
  WHERE week <= 40 AND weight IS NOT NULL)"""


@query("analysis_weight_counts", f"""
WITH {_GROUPED} SELECT sex, onset_group, COUNT(DISTINCT subject_id) AS n_subjects, COUNT(weight) AS n_values FROM gw GROUP BY 1, 2""")
def weight_counts(spark, d):
    return reports.weight_report(*_study(spark, d), cutoffs=_CUTS, key="NR_Name")["counts"]


@query("analysis_weight_welch", f"""
WITH {_GROUPED}, {_WELCH.format(by="sex, week", v="weight", src="gw")}
SELECT sex, week, {_WELCH_OUT}, ROUND({_T_TAIL.format(t="t", df="df")}, 6) + 0.0 AS p FROM tt""")
def weight_welch(spark, d):
    return reports.weight_report(*_study(spark, d), cutoffs=_CUTS, key="NR_Name")["welch"]


@query("analysis_growth_welch", f"""
WITH {_GROUPED}, gg AS (SELECT sex, onset_group, COALESCE((wt8 - wt4) / NULLIF(wt8, 0) * 100, 0) AS percent_increase
  FROM fx_wide JOIN grp USING (subject_id) WHERE wt4 IS NOT NULL AND wt8 IS NOT NULL),
{_WELCH.format(by="sex", v="percent_increase", src="gg")}
SELECT sex, {_WELCH_OUT}, ROUND({_T_TAIL.format(t="t", df="df")}, 6) + 0.0 AS p FROM tt""")
def growth_welch(spark, d):
    return reports.growth_report(*_study(spark, d), cutoffs=_CUTS, key="NR_Name")["welch"]


_P = ", ".join(f"MAX(CASE WHEN week = {w} THEN ROUND_EVEN(CAST(weight * 2 AS BIGINT) + 0.5, 0) END) AS wtpt{w}" for w in (4, 8, 12))


@query("m1_percentile_features", f"""
WITH pt AS (SELECT subject_id, {_P} FROM fx_measurement WHERE week IN (4, 8, 12) GROUP BY subject_id)
SELECT CAST(subject_id AS VARCHAR) AS "NR_Name", sex, rbg200, gestational_diet = 'Rab' AS gestational_diet, nursing_diet = 'Rab' AS nursing_diet,
  weanling_diet = 'Rab' AS weanling_diet, wt4, wt8, wt12, rbg4, rbg8, rbg12, CAST(wtpt4 AS DOUBLE) AS wtpt4, CAST(wtpt8 AS DOUBLE) AS wtpt8,
  CAST(wtpt12 AS DOUBLE) AS wtpt12, wt8 - wt4 AS diff48
FROM fx_wide JOIN pt USING (subject_id) JOIN fx_onset USING (subject_id)""")
def percentile_features(spark, d):
    """Readings, diets and weight percentiles: the columns of all sixteen feature lists."""
    return feature_table(*_study(spark, d), measures={"weight": "wt", "rbg": "rbg", "weight percentile": "wtpt"}, diet_values=("Rab",),
                         key="NR_Name", keep=("sex", "rbg200"))


def breeding(spark, d):
    """The breeding table as the study exports it: an order is a litter."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    columns = {"breeding_ID": k, "mother": F.col("o_custkey").cast("string"), "mating_date": F.date_format(F.date_sub(day, 21), _DAY),
               "pups_born": F.date_format(day, _DAY), "weaned_date": F.when(k % 3 > 0, F.date_format(F.date_add(day, 21), _DAY)).otherwise("soon"),
               "maternal_onset": F.when(k % 4 == 0, "x").otherwise((k % 40).cast("string")), "paternal_onset": (k % 36).cast("string")}
    for days in (0, 7, 14, 21):
        there = k % 7 > 0
        columns[f"d{days}_date"] = F.when(there, F.date_format(F.date_add(day, days), _DAY))
        columns[f"d{days}_count"] = F.when(there, F.when(k % 5 == days % 5, "lost").otherwise(F.concat((F.col("o_custkey") % 12).cast("string"), F.lit(".5"))))
        columns[f"d{days}_weight"] = F.when(there, F.concat(F.floor(F.col("o_totalprice") / 1000 + days).cast("string"), F.lit(".75")))
    return _shaped(table(spark, d, "orders").select(*[c.alias(n) for n, c in columns.items()]), BREEDING_SCHEMA)


@query("s1_breeding_table", """
SELECT o_orderkey AS "breeding_ID", CAST(o_orderdate AS DATE) - 21 AS mating_date, CAST(o_orderdate AS DATE) AS pups_born,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 21 END AS weaned_date,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 40 END AS maternal_onset, o_orderkey % 36 AS paternal_onset FROM orders""")
def breeding_table(spark, d):
    return clean_breeding(breeding(spark, d)).select("breeding_ID", "mating_date", "pups_born", "weaned_date", "maternal_onset", "paternal_onset")


@query("p6_litter_readings", "SELECT " + ", ".join(
    f"CAST(o_orderdate AS DATE) + {n} AS d{n}_date, CASE WHEN o_orderkey % 5 <> {n % 5} THEN CAST(ROUND_EVEN(o_custkey % 12 + 0.5, 0) AS BIGINT) END AS d{n}_count, "
    f"FLOOR(o_totalprice / 1000 + {n}) + 1.0 AS d{n}_weight" for n in (0, 7, 14, 21)) + " FROM orders WHERE o_orderkey % 7 > 0")
def litters(spark, d):
    return litter_readings(clean_breeding(breeding(spark, d)))
