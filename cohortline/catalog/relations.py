"""Joins, aggregations, windows, reshaping, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortline.catalog.registry import query
from cohortline.catalog.views import measurements, onset, panel as both, raw_panel, stored_onset, subjects, table, wide
from cohortline.functions import columns as C
from cohortline.operators import clean, incidence, lineage, onset as O, panel
from cohortline.operators.evaluate import score_summary
from cohortline.operators.running import running_totals
from cohortline.operators.stats import group_counts, overlap
from cohortline.operators.survival import event_times
from cohortline.session import materialize


@query("j1_inner_join", "SELECT subject_id, wt4, rbg4, sex, rbg200 FROM fx_wide JOIN fx_onset USING (subject_id) WHERE subject_id IN (SELECT subject_id FROM fx_measurement WHERE week = 4)")
def j1(spark, d):
    m, o = both(spark, d)
    wt = panel.pivot_weeks(m, "subject_id", (4,), {"weight": "wt", "rbg": "rbg"})
    return wt.join(
        o.select("subject_id", "sex", "rbg200"), "subject_id")


@query("j2_left_join", """
SELECT w.subject_id, rbg8, rbg200 FROM fx_wide w
LEFT JOIN (SELECT * FROM fx_onset WHERE overall_diet = 'Rod') o ON o.subject_id = w.subject_id""")
def j2(spark, d):
    m, o = both(spark, d)
    rod = o.filter("overall_diet = 'Rod'").select("subject_id", "rbg200")
    return panel.pivot_weeks(m, "subject_id", (4, 8, 12), {"rbg": "rbg"}).select("subject_id", "rbg8").join(rod, "subject_id", "left")


@query("j3_full_outer_join", """
WITH a AS (SELECT subject_id, weight AS wt4 FROM fx_measurement WHERE week = 4),
b AS (SELECT subject_id, rbg AS rbg8 FROM fx_measurement WHERE week = 8)
SELECT COALESCE(a.subject_id, b.subject_id) AS subject_id, wt4, rbg8 FROM a FULL JOIN b ON a.subject_id = b.subject_id""")
def j3(spark, d):
    m = materialize(measurements(spark, d))
    a = m.filter("week = 4").select("subject_id", F.col("weight").alias("wt4"))
    b = m.filter("week = 8").select("subject_id", F.col("rbg").alias("rbg8"))
    return a.join(b, "subject_id", "outer")


@query("j4_parent_onset", """
SELECT o.subject_id, o.mother, o.father, o.rbg200, m.rbg200 AS rbg200_mo, f.rbg200 AS rbg200_fa
FROM fx_onset o LEFT JOIN fx_onset m ON m.subject_id = o.mother LEFT JOIN fx_onset f ON f.subject_id = o.father""")
def j4(spark, d):
    o = stored_onset(spark, d)
    return lineage.parent_onset(o.select("subject_id", "mother", "father", "rbg200"), o)


@query("j5_left_join_two_keys", """
SELECT m.subject_id, m.week, m.diet, r.n FROM fx_measurement m
LEFT JOIN (SELECT subject_id, week, COUNT(*) AS n FROM fx_raw WHERE o_totalprice > 200000 GROUP BY 1, 2) r
ON r.subject_id = m.subject_id AND r.week = m.week""")
def j5(spark, d):
    high = raw_panel(spark, d).filter("o_totalprice > 200000").groupBy("subject_id", "week").agg(F.count(F.lit(1)).alias("n"))
    return measurements(spark, d).select("subject_id", "week", "diet").join(high, ["subject_id", "week"], "left")


@query("j6_join_shared_key", "SELECT subject_id, week, rbg, nursing_diet FROM fx_measurement JOIN fx_main USING (subject_id)")
def j6(spark, d):
    return measurements(spark, d).select("subject_id", "week", "rbg").join(
        subjects(spark, d).select("subject_id", "nursing_diet"), "subject_id")


@query("j7_join_pivot_index", """
SELECT subject_id, wt4, wt8, wt12 FROM (SELECT DISTINCT subject_id FROM fx_measurement) JOIN fx_wide USING (subject_id)""")
def j7(spark, d):
    m = materialize(measurements(spark, d))
    pivot = panel.pivot_weeks(m, "subject_id", (4, 8, 12), {"weight": "wt"})
    return m.select("subject_id").distinct().join(pivot, "subject_id")


@query("j8_semi_join", """
SELECT subject_id, rbg, diet FROM fx_measurement WHERE diet IN ('Rod', 'Rab') AND subject_id IN
(SELECT subject_id FROM fx_main WHERE (overall_diet = 'Rod' OR weanling_diet = 'Rab') AND weanling_diet = overall_diet)""")
def j8(spark, d):
    kept = subjects(spark, d).filter("(overall_diet = 'Rod' OR weanling_diet = 'Rab') AND weanling_diet = overall_diet")
    rows = measurements(spark, d).filter(F.col("diet").isin("Rod", "Rab")).select("subject_id", "rbg", "diet")
    return clean.keep_ids(rows, kept, "subject_id")


@query("j9_anti_join", "SELECT * FROM fx_measurement WHERE subject_id NOT IN (SELECT subject_id FROM fx_onset WHERE rbg200 <= 4)")
def j9(spark, d):
    m, o = both(spark, d)
    return clean.drop_keys(m, o.filter("rbg200 <= 4"), "subject_id")


@query("j10_join_other_names", """
SELECT c.subject_id, c.mother, m.sex AS mother_sex FROM fx_main c JOIN fx_main m ON m.subject_id = c.mother""")
def j10(spark, d):
    s = subjects(spark, d)
    m = s.select(F.col("subject_id").alias("mother_id"), F.col("sex").alias("mother_sex"))
    c = s.select("subject_id", "mother")
    return c.join(m, c.mother == m.mother_id).drop("mother_id")


@query("a1_first_crossing", "SELECT subject_id, r100 AS rbg100, r120 AS rbg120, r200 AS rbg200, r300 AS rbg300 FROM fx_cross")
def a1(spark, d):
    return O.first_crossings(measurements(spark, d))


@query("a2_onset_table", "SELECT * FROM fx_onset")
def a2(spark, d):
    return onset(spark, d)


@query("a3_group_size", "SELECT sex, rbg200, COUNT(*) AS n FROM fx_onset GROUP BY 1, 2")
def a3(spark, d):
    return onset(spark, d).groupBy("sex", "rbg200").agg(F.count(F.lit(1)).alias("n"))


@query("a4_group_means", """
SELECT subject_id, ROUND(AVG(rbg), 6) AS rbg, ROUND(AVG(weight), 6) AS weight, ROUND(AVG(week), 6) AS week
FROM fx_measurement GROUP BY 1""")
def a4(spark, d):
    return measurements(spark, d).groupBy("subject_id").agg(*[F.avg(c).alias(c) for c in ("rbg", "weight", "week")])


@query("a5_last_week", "SELECT subject_id, MAX(week) AS last_week FROM fx_measurement GROUP BY 1")
def a5(spark, d):
    return O.last_week(measurements(spark, d))


@query("a6_group_moments", """
SELECT week, COUNT(weight) AS n, ROUND(AVG(weight), 6) AS mean, ROUND(STDDEV_SAMP(weight), 6) AS sd, MIN(weight) AS low,
       MAX(weight) AS high FROM fx_measurement GROUP BY week""")
def a6(spark, d):
    return measurements(spark, d).groupBy("week").agg(
        F.count("weight").alias("n"), F.avg("weight").alias("mean"), F.stddev_samp("weight").alias("sd"),
        F.min("weight").alias("low"), F.max("weight").alias("high"))


@query("a7_distinct_subjects", """
SELECT diet, COUNT(DISTINCT subject_id) AS n_subjects, COUNT(weight) AS n_values FROM fx_measurement GROUP BY diet""")
def a7(spark, d):
    return group_counts(measurements(spark, d), "subject_id", "weight", ["diet"])


@query("a8_frequency_table", "SELECT nursing_diet, COUNT(*) AS n FROM fx_main GROUP BY 1")
def a8(spark, d):
    return subjects(spark, d).groupBy("nursing_diet").agg(F.count(F.lit(1)).alias("n"))


@query("a9_null_counts", """
SELECT 'weight' AS column_name, COUNT(*) - COUNT(weight) AS n_null FROM fx_measurement
UNION ALL SELECT 'rbg', COUNT(*) - COUNT(rbg) FROM fx_measurement
UNION ALL SELECT 'diet', COUNT(*) - COUNT(diet) FROM fx_measurement""")
def a9(spark, d):
    return clean.null_counts(measurements(spark, d), ["weight", "rbg", "diet"])


@query("a10_any_flag", """
SELECT mother, MAX(CASE WHEN rbg200 <= 4 THEN 1 ELSE 0 END) = 1 AS any_onset,
       CAST(SUM(CASE WHEN rbg200 <= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_onset FROM fx_onset GROUP BY mother""")
def a10(spark, d):
    flag = F.col("rbg200") <= 4
    return onset(spark, d).groupBy("mother").agg(F.bool_or(flag).alias("any_onset"), F.count_if(flag).alias("n_onset"))


@query("a11_score_summary", """
SELECT sex, ROUND(AVG(rbg300), 6) AS mean_score, ROUND(STDDEV_POP(rbg300), 6) AS sd_score FROM fx_onset GROUP BY sex""")
def a11(spark, d):
    return score_summary(onset(spark, d), "rbg300", ["sex"])


@query("w1_running_count", """
WITH c AS (SELECT sex, rbg300, COUNT(*) AS n FROM fx_onset GROUP BY 1, 2)
SELECT sex, rbg300, n, CAST(SUM(n) OVER (PARTITION BY sex ORDER BY rbg300) AS BIGINT) AS cumulative FROM c""")
def w1(spark, d):
    counts = onset(spark, d).groupBy("sex", "rbg300").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, "rbg300", {"cumulative": "n"}, ["sex"], bounded=True)


@query("w1_running_count_long_axis", """
WITH c AS (SELECT o_orderstatus, o_totalprice, COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_totalprice, n,
       CAST(SUM(n) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS BIGINT) AS cumulative FROM c""")
def w1b(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus", "o_totalprice").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, "o_totalprice", {"cumulative": "n"}, ["o_orderstatus"], descending=True)


@query("w1_running_count_prices", """
WITH c AS (SELECT l_returnflag, l_extendedprice, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_extendedprice, n, CAST(SUM(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS BIGINT) AS cumulative FROM c""")
def w1c(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, "l_extendedprice", {"cumulative": "n"}, ["l_returnflag"])


@query("w2_group_max", """
WITH c AS (SELECT sex, rbg200, COUNT(*) AS n FROM fx_onset GROUP BY 1, 2)
SELECT sex, rbg200, n, MAX(n) OVER (PARTITION BY sex) AS max_n FROM c""")
def w2(spark, d):
    counts = onset(spark, d).groupBy("sex", "rbg200").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("max_n", F.max("n").over(Window.partitionBy("sex")))


@query("w3_first_row", """
SELECT subject_id, week, measurement_id, rbg FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY week, measurement_id) AS rn FROM fx_measurement) WHERE rn = 1""")
def w3(spark, d):
    return panel.first_row(measurements(spark, d).select("subject_id", "week", "measurement_id", "rbg"),
                           "subject_id", ["week", "measurement_id"])


@query("w4_least_week_row", """
SELECT subject_id, week, measurement_id, rbg, weight, diet FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY week) AS rn FROM fx_measurement WHERE rbg > 200) WHERE rn = 1""")
def w4(spark, d):
    return O.first_reading_above(measurements(spark, d), 200)


@query("w5_sibling_onset", """
WITH a AS (SELECT *, CASE WHEN rbg200 <= 4 THEN 1 ELSE 0 END AS own FROM fx_onset)
SELECT a.subject_id, CASE WHEN EXISTS (SELECT 1 FROM a b WHERE b.mother = a.mother AND b.subject_id <> a.subject_id AND b.own = 1)
       THEN 1 ELSE 0 END AS rbg200_sib FROM a""")
def w5(spark, d):
    return lineage.sibling_onset(stored_onset(spark, d), {"M": 4, "F": 4}).select("subject_id", "rbg200_sib")


@query("r1_pivot_weeks", "SELECT * FROM fx_wide")
def r1(spark, d):
    return wide(spark, d)


_WEEKS = tuple(range(4, 48, 4))


@query("r2_wide_export", f"""
WITH p AS (SELECT subject_id, {', '.join(f"MAX(CASE WHEN week = {w} THEN {m} END) AS {m}{w}" for m in ('weight', 'rbg', 'diet') for w in range(4, 84, 4))}
  FROM fx_measurement GROUP BY subject_id)
SELECT subject_id, birth_date, rbg200, p.* EXCLUDE (subject_id) FROM fx_onset JOIN p USING (subject_id)
WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def r2(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("subject_id"))
    return panel.wide_export(*both(spark, d), ids, "subject_id")


@query("r3_stack_pivots", "\nUNION ALL ".join(
    f"SELECT subject_id, '{m}' AS measure, " + ", ".join(
        f"MAX(CASE WHEN week = {w} THEN {e} END) AS w{w}" for w in _WEEKS) + " FROM fx_measurement GROUP BY subject_id"
    for m, e in (("week", "CAST(week AS VARCHAR)"), ("measurement_id", "CAST(measurement_id AS VARCHAR)"), ("diet", "diet"))))
def r3(spark, d):
    rows = measurements(spark, d)
    return panel.stack_pivots(rows, "subject_id", _WEEKS, ("week", "measurement_id", "diet"))


@query("r4_result_pivot", """
WITH c AS (SELECT sex, rbg300, COUNT(*) AS n FROM fx_onset GROUP BY 1, 2)
SELECT rbg300, CAST(COALESCE(MAX(CASE WHEN sex = 'M' THEN n END), 0) AS BIGINT) AS "M",
       CAST(COALESCE(MAX(CASE WHEN sex = 'F' THEN n END), 0) AS BIGINT) AS "F" FROM c GROUP BY rbg300""")
def r4(spark, d):
    counts = onset(spark, d).groupBy("sex", "rbg300").agg(F.count(F.lit(1)).alias("n"))
    return panel.pivot_result(counts, ["rbg300"], "sex", ["M", "F"], "n", fill=0)


@query("l1_sort", "SELECT sex, rbg300, COUNT(*) AS n FROM fx_onset GROUP BY 1, 2 ORDER BY sex, rbg300")
def l1(spark, d):
    return onset(spark, d).groupBy("sex", "rbg300").agg(F.count(F.lit(1)).alias("n")).orderBy("sex", "rbg300")


@query("l2_distinct_times", "SELECT DISTINCT week FROM fx_measurement ORDER BY week")
def l2(spark, d):
    return event_times(measurements(spark, d), "week")


@query("l3_first_rows", """
SELECT subject_id, week - 4 AS week, weight, rbg FROM fx_measurement ORDER BY subject_id, week LIMIT 5""")
def l3(spark, d):
    return measurements(spark, d).select("subject_id", (F.col("week") - 4).alias("week"), "weight", "rbg").orderBy(
        "subject_id", "week").limit(5)


@query("u1_union_all", """
SELECT subject_id, sex, 'Rod' AS diet FROM fx_main WHERE nursing_diet = 'Rod'
UNION ALL SELECT subject_id, sex, 'Rab' FROM fx_main WHERE nursing_diet = 'Rab'""")
def u1(spark, d):
    s = subjects(spark, d)
    parts = [s.filter(F.col("nursing_diet") == v).select("subject_id", "sex", F.lit(v).alias("diet")) for v in ("Rod", "Rab")]
    return parts[0].unionByName(parts[1])


@query("u2_intersect", """
SELECT subject_id FROM fx_measurement WHERE week = 4 INTERSECT SELECT subject_id FROM fx_measurement WHERE rbg > 300""")
def u2(spark, d):
    m = materialize(measurements(spark, d))
    return overlap(m.filter("week = 4"), m.filter("rbg > 300"), "subject_id")


@query("u3_subtract", "SELECT subject_id FROM fx_measurement EXCEPT SELECT subject_id FROM fx_measurement WHERE rbg > 300")
def u3(spark, d):
    m = materialize(measurements(spark, d))
    return m.select("subject_id").subtract(m.filter("rbg > 300").select("subject_id"))


@query("u4_distinct_rows", "SELECT DISTINCT subject_id, diet FROM fx_measurement")
def u4(spark, d):
    return measurements(spark, d).select("subject_id", "diet").distinct()


@query("scalar_functions", """
SELECT subject_id, week % 8 AS m, round_even(rbg / 2, 0) AS half, ROUND(SQRT(rbg), 6) AS root, ABS(rbg - 200) AS gap,
       ROUND(POWER(rbg / 100, 2), 6) AS square, date_diff('day', birth_date, death_date) AS days,
       ROUND(date_diff('day', birth_date, death_date) / 7, 6) AS weeks, 'rbg' || CAST(week AS VARCHAR) AS name,
       CASE WHEN rbg > 200 THEN 'high' WHEN rbg IS NULL THEN 'none' ELSE 'low' END AS level,
       (rbg > 200 OR COALESCE(weight > 100, FALSE) OR mother IS NOT NULL) AS any_flag
FROM fx_measurement JOIN fx_main USING (subject_id)""")
def scalar(spark, d):
    rows = measurements(spark, d).join(subjects(spark, d), "subject_id")
    days = F.datediff("death_date", "birth_date")
    rbg = F.col("rbg")
    return rows.select(
        "subject_id", (F.col("week") % 8).alias("m"), F.bround(rbg / 2, 0).alias("half"), F.sqrt(rbg).alias("root"),
        F.abs(rbg - 200).alias("gap"), F.pow(rbg / 100, 2).alias("square"), days.cast("long").alias("days"),
        (days / 7).alias("weeks"), F.concat(F.lit("rbg"), F.col("week").cast("string")).alias("name"),
        F.when(rbg > 200, "high").when(rbg.isNull(), "none").otherwise("low").alias("level"),
        C.any_flag(rbg > 200, F.col("weight") > 100, F.col("mother").isNotNull()).alias("any_flag"))


_INCIDENCE = """
kept AS (SELECT *, CASE WHEN rbg200 <= 40 THEN rbg200 ELSE 80 END AS wk FROM fx_onset
  WHERE overall_diet = 'Rod' AND weanling_diet = 'Rod' AND nursing_diet IN ('Rod', 'Rab') AND gestational_diet = nursing_diet
  AND (rbg200 <= 40 OR date_diff('day', birth_date, death_date) >= 280)),
cnt AS (SELECT sex, nursing_diet, wk, COUNT(*) AS n FROM kept GROUP BY 1, 2, 3),
inc AS (SELECT sex, wk AS rbg200, n AS count, CAST(SUM(n) OVER (PARTITION BY sex, nursing_diet ORDER BY wk) AS BIGINT) AS cumulative,
  SUM(n) OVER (PARTITION BY sex, nursing_diet ORDER BY wk) * 100.0 / SUM(n) OVER (PARTITION BY sex, nursing_diet) AS percent,
  nursing_diet AS nursing FROM cnt)"""


@query("g1_cumulative_incidence", f"""
WITH {_INCIDENCE} SELECT sex, rbg200, count, cumulative, ROUND(percent, 6) AS percent FROM inc WHERE nursing = 'Rod'""")
def g1(spark, d):
    return incidence.cumulative_incidence(incidence.maternal_diet_cohort(onset(spark, d), "Rod"))


_PIVOT = _INCIDENCE + """,
piv AS (SELECT sex, rbg200, COALESCE(MAX(CASE WHEN nursing = 'Rod' THEN percent END), 0) AS rod,
  COALESCE(MAX(CASE WHEN nursing = 'Rab' THEN percent END), 0) AS rab FROM inc WHERE rbg200 <> 4 GROUP BY 1, 2)"""


@query("g2_incidence_pivot", f"""
WITH {_PIVOT} SELECT sex, rbg200, ROUND(rod, 6) AS "Rod", ROUND(rab, 6) AS "Rab" FROM piv""")
def g2(spark, d):
    return incidence.incidence_pivot(incidence.incidence_by_diet(onset(spark, d)))


@query("g2_incidence_by_diet", f"""
WITH {_INCIDENCE} SELECT sex, rbg200, count, cumulative, ROUND(percent, 6) AS percent, nursing FROM inc WHERE rbg200 <> 4""")
def g2b(spark, d):
    return incidence.incidence_by_diet(onset(spark, d))


@query("g3_survival_percent", f"""
WITH {_PIVOT} SELECT sex, rbg200, ROUND(100 - rod, 6) AS "Rod", ROUND(100 - rab, 6) AS "Rab" FROM piv WHERE rbg200 <> 80""")
def g3(spark, d):
    return incidence.survival_percent(incidence.incidence_pivot(incidence.incidence_by_diet(onset(spark, d))))


@query("g4_binomial_band", f"""
WITH {_PIVOT}, sz AS (SELECT sex, COUNT(*) AS n FROM kept GROUP BY sex),
lg AS (SELECT sex, rbg200, 'Rod' AS nursing, 100 - rod AS p FROM piv WHERE rbg200 <> 80
  UNION ALL SELECT sex, rbg200, 'Rab', 100 - rab FROM piv WHERE rbg200 <> 80)
SELECT sex, rbg200, n, nursing, ROUND(p, 6) AS percent_free, ROUND(p - 1.96 * SQRT(p * (100 - p) / n), 6) AS lower,
       ROUND(p + 1.96 * SQRT(p * (100 - p) / n), 6) AS upper FROM lg JOIN sz USING (sex)""")
def g4(spark, d):
    o = stored_onset(spark, d)
    survival = incidence.survival_percent(incidence.incidence_pivot(incidence.incidence_by_diet(o)))
    full = incidence.incidence_by_diet(o, drop_week=None)
    sizes = full.groupBy("sex").agg(F.sum("count").alias("n"))
    return incidence.binomial_band(survival, sizes)
