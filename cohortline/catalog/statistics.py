"""Group statistics, event tables and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query
from cohortline.catalog.views import measurements, onset, panel, table
from cohortline.functions.columns import encode_map
from cohortline.functions.tails import with_p_value
from cohortline.operators import onset as O
from cohortline.operators import stats
from cohortline.operators.clean import on_grid
from cohortline.operators.evaluate import regression_error
from cohortline.operators.incidence import incidence_by_diet
from cohortline.operators.folds import fold_by_subject
from cohortline.operators.panel import pivot_weeks
from cohortline.operators.mixed import mixed_model, subject_likelihoods
from cohortline.operators.survival import (
    brier, brier_all_times, censoring_curve, concordance, cox_fits, cox_ph, integrated_brier, risk_sets, subject_rows, td_auc, td_auc_all_times)
from cohortline.session import materialize
from cohortline.plans.joint import cross_validate_survival, index_categories, longitudinal_cohort

GROUPS = {"M": 8, "F": 12}  # cutoff weeks that give both groups members in the given tables


def _groups(spark, d):
    """Readings, and the onset or no-onset group of each subject."""
    m, o = panel(spark, d)
    return m, O.onset_groups(O.cohort(o, overall_diet="Rod"), GROUPS, "rbg300").select("subject_id", "sex", "onset_group")


def _grouped(spark, d):
    """Weights by week of the onset and no-onset groups."""
    m, groups = _groups(spark, d)
    rows = on_grid(m).filter((F.col("week") <= 40) & F.col("weight").isNotNull())
    return rows.select("subject_id", "week", "weight").join(groups, "subject_id")


_GROUPED = """
grp AS (SELECT subject_id, sex, CASE WHEN rbg300 <= cut THEN 'onset' ELSE 'no onset' END AS onset_group
  FROM (SELECT *, CASE sex WHEN 'M' THEN 8 ELSE 12 END AS cut FROM fx_onset WHERE overall_diet = 'Rod')
  WHERE rbg300 <= cut OR date_diff('day', birth_date, death_date) >= 7 * cut),
gw AS (SELECT subject_id, week, weight, sex, onset_group FROM fx_measurement JOIN grp USING (subject_id)
  WHERE week % 4 = 0 AND week <= 40 AND weight IS NOT NULL)"""

# two-sided tails by Simpson's rule, as DuckDB has no distribution functions
_T_TAIL = """1 - 2 * (ABS({t}) / 6000) * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * EXP(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * LN(PI() * {df})
        - ({df} + 1) / 2 * LN(1 + POWER(ABS({t}) * i / 2000, 2) / {df}))))"""
_Z_TAIL = """1 - 2 * (ABS({z}) / 6000) * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * EXP(-0.5 * POWER(ABS({z}) * i / 2000, 2)) / SQRT(2 * PI())))"""

_WELCH = """
mom AS (SELECT {by}, COUNT({v}) FILTER (onset_group = 'onset') AS n1, COUNT({v}) FILTER (onset_group = 'no onset') AS n2,
  AVG({v}) FILTER (onset_group = 'onset') AS mean1, AVG({v}) FILTER (onset_group = 'no onset') AS mean2,
  VAR_SAMP({v}) FILTER (onset_group = 'onset') AS v1, VAR_SAMP({v}) FILTER (onset_group = 'no onset') AS v2
  FROM {src} GROUP BY {by}),
tt AS (SELECT {by}, n1, n2, mean1, mean2, (mean1 - mean2) / NULLIF(SQRT(v1 / n1 + v2 / n2), 0) AS t,
  POWER(v1 / n1 + v2 / n2, 2) / NULLIF(POWER(v1 / n1, 2) / NULLIF(n1 - 1, 0) + POWER(v2 / n2, 2) / NULLIF(n2 - 1, 0), 0) AS df
  FROM mom)"""
_WELCH_OUT = "n1, n2, ROUND(mean1, 6) AS mean1, ROUND(mean2, 6) AS mean2, ROUND(t, 6) AS t, ROUND(df, 6) AS df"


@query("g5_welch_by_week", f"""
WITH {_GROUPED}, {_WELCH.format(by="sex, week", v="weight", src="gw")} SELECT sex, week, {_WELCH_OUT} FROM tt""")
def g5(spark, d):
    return stats.welch_ttest(_grouped(spark, d), "weight", "onset_group", ("onset", "no onset"), ("sex", "week"), p=False)


@query("g12_welch_p_values", f"""
WITH {_GROUPED}, {_WELCH.format(by="sex, week", v="weight", src="gw")}
SELECT sex, week, {_WELCH_OUT}, ROUND({_T_TAIL.format(t="t", df="df")}, 6) + 0.0 AS p FROM tt""")
def g12(spark, d):
    return stats.welch_ttest(_grouped(spark, d), "weight", "onset_group", ("onset", "no onset"), ("sex", "week"))


_GROWTH = """
gr AS (SELECT subject_id, wt4 AS weight4, wt8 AS weight8, COALESCE((wt8 - wt4) / NULLIF(wt8, 0) * 100, 0) AS percent_increase
  FROM fx_wide WHERE wt4 IS NOT NULL AND wt8 IS NOT NULL)"""


@query("g6_growth", f"""
WITH {_GROWTH} SELECT subject_id, weight4, weight8, ROUND(percent_increase, 6) AS percent_increase FROM gr""")
def g6(spark, d):
    return stats.growth(measurements(spark, d))


@query("g6_growth_welch", f"""
WITH {_GROUPED}, {_GROWTH}, gg AS (SELECT * FROM gr JOIN grp USING (subject_id)),
{_WELCH.format(by="sex", v="percent_increase", src="gg")}
SELECT sex, {_WELCH_OUT}, ROUND({_T_TAIL.format(t="t", df="df")}, 6) + 0.0 AS p FROM tt""")
def g6b(spark, d):
    m, groups = _groups(spark, d)
    rows = stats.growth(m).join(groups, "subject_id")
    return stats.welch_ttest(rows, "percent_increase", "onset_group", ("onset", "no onset"), ("sex",))


def _wide(m):
    return pivot_weeks(m, "subject_id", (4, 8, 12), {"weight": "wt", "rbg": "rbg"})


_CORR = ("wt4", "wt8", "wt12", "rbg4", "rbg8", "rbg12", "nursing", "constant")


@query("g7_corr_matrix", "WITH cr AS (SELECT w.*, sex, CAST(nursing_diet = 'Rod' AS DOUBLE) AS nursing, 1.0::DOUBLE AS constant "
       "FROM fx_wide w JOIN fx_onset USING (subject_id))\n" + "\nUNION ALL ".join(
           f"SELECT sex, '{a}' AS x, '{b}' AS y, CASE WHEN STDDEV_POP({a}) FILTER ({b} IS NOT NULL) > 0 AND "
           f"STDDEV_POP({b}) FILTER ({a} IS NOT NULL) > 0 THEN ROUND(CORR({a}, {b}), 6) END AS r FROM cr GROUP BY sex"
           for a in _CORR for b in _CORR))
def g7(spark, d):
    m, o = panel(spark, d)
    flags = o.select("subject_id", "sex", (F.col("nursing_diet") == "Rod").cast("int").alias("nursing"))
    rows = _wide(m).join(flags, "subject_id").withColumn("constant", F.lit(1.0))
    return stats.corr_matrix(rows, _CORR, ("sex",))


_BOX = """
q AS (SELECT {by}, QUANTILE_CONT({v}, 0.25) AS q1, QUANTILE_CONT({v}, 0.5) AS median, QUANTILE_CONT({v}, 0.75) AS q3
  FROM {src} WHERE {v} IS NOT NULL GROUP BY {by})"""


@query("g8_box_summary", f"""
WITH {_BOX.format(by="diet", v="rbg", src="fx_measurement")}
SELECT diet, COUNT(*) AS n, MIN(rbg) AS min, ROUND(MAX(q1), 6) AS q1, ROUND(MAX(median), 6) AS median, ROUND(MAX(q3), 6) AS q3,
  MAX(rbg) AS max, MIN(rbg) FILTER (rbg >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  MAX(rbg) FILTER (rbg <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  COUNT(*) FILTER (rbg < q1 - 1.5 * (q3 - q1) OR rbg > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM fx_measurement JOIN q USING (diet) GROUP BY diet""")
def g8(spark, d):
    return stats.box_summary(measurements(spark, d), "rbg", ("diet",))


@query("g8_growth_box", f"""
WITH {_GROUPED}, {_GROWTH}, gg AS (SELECT *, ROUND(percent_increase, 9) AS v FROM gr JOIN grp USING (subject_id)),
{_BOX.format(by="sex, onset_group", v="v", src="gg")}
SELECT sex, onset_group, COUNT(*) AS n, ROUND(MIN(v), 6) AS min, ROUND(MAX(q1), 6) AS q1, ROUND(MAX(median), 6) AS median,
  ROUND(MAX(q3), 6) AS q3, ROUND(MAX(v), 6) AS max,
  ROUND(MIN(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  ROUND(MAX(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  COUNT(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM gg JOIN q USING (sex, onset_group) GROUP BY sex, onset_group""")
def g8b(spark, d):
    m, groups = _groups(spark, d)
    rows = stats.growth(m).join(groups, "subject_id").withColumn("v", F.round("percent_increase", 9))
    return stats.box_summary(rows, "v", ("sex", "onset_group"))


@query("g8_outliers", f"""
WITH {_BOX.format(by="diet", v="weight", src="fx_measurement")}
SELECT m.subject_id, m.week, m.diet, m.weight FROM fx_measurement m JOIN q USING (diet)
WHERE weight < q1 - 1.5 * (q3 - q1) OR weight > q3 + 1.5 * (q3 - q1)""")
def g8c(spark, d):
    return stats.outliers(measurements(spark, d).select("subject_id", "week", "diet", "weight"), "weight", ("diet",))


@query("g9_histogram", """
WITH e AS (SELECT MIN(rbg) AS lo, MAX(rbg) AS hi FROM fx_measurement),
b AS (SELECT diet, CAST(LEAST(FLOOR((rbg - lo) / 10), GREATEST(CEIL((hi - lo) / 10) - 1, 0)) AS INT) AS bin, lo
  FROM fx_measurement, e WHERE rbg IS NOT NULL),
n AS (SELECT diet, COUNT(rbg) AS size FROM fx_measurement GROUP BY diet)
SELECT diet, bin, lo + bin * 10.0 AS left_edge, COUNT(*) AS count, ROUND(COUNT(*) / (MAX(size) * 10.0), 6) AS density
FROM b JOIN n USING (diet) GROUP BY diet, bin, lo""")
def g9(spark, d):
    return stats.histogram(measurements(spark, d), "rbg", ("diet",), 10.0)


@query("g10_kernel_density", """
WITH e AS (SELECT MIN(rbg) AS lo, MAX(rbg) AS hi FROM fx_measurement),
s AS (SELECT diet, COUNT(rbg) AS n, STDDEV_SAMP(rbg) * POWER(COUNT(rbg), -0.2) AS h FROM fx_measurement GROUP BY diet),
v AS (SELECT diet, rbg, COUNT(*) AS w FROM fx_measurement WHERE rbg IS NOT NULL GROUP BY 1, 2),
g AS (SELECT CAST(i AS INT) AS point, lo + (hi - lo) * i / 49 AS x FROM e, range(50) t(i))
SELECT diet, point, ROUND(x, 6) AS x, ROUND(SUM(w * EXP(-0.5 * POWER((x - rbg) / NULLIF(h, 0), 2)) / (n * NULLIF(h, 0) * SQRT(2 * PI()))), 6) AS density
FROM v JOIN s USING (diet), g GROUP BY diet, point, x""")
def g10(spark, d):
    return stats.kde(measurements(spark, d), "rbg", ("diet",), grid=50)


@query("g11_group_counts", f"""
WITH {_GROUPED} SELECT sex, onset_group, COUNT(DISTINCT subject_id) AS n_subjects, COUNT(weight) AS n_values
FROM gw GROUP BY 1, 2""")
def g11(spark, d):
    return stats.group_counts(_grouped(spark, d), "subject_id", "weight", ("sex", "onset_group"))


@query("g12_chi_square_tail", """
WITH c AS (SELECT l_shipdate, COUNT(*) AS n, COUNT(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
s AS (SELECT l_shipdate, n, POWER(r - n / 3.0, 2) / (n * 2 / 9.0) AS chi2 FROM c)
SELECT CAST(l_shipdate AS DATE) AS day, n, ROUND(chi2, 6) AS chi2, ROUND(1 - 2 * (SQRT(chi2) / 6000) * list_sum(
  list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * EXP(-0.5 * POWER(SQRT(chi2) * i / 2000, 2)) / SQRT(2 * PI()))), 6) + 0.0 AS p FROM s""")
def g12b(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    gap = F.col("r") - F.col("n") / 3.0
    t = c.select("day", "n", (gap * gap / (F.col("n") * 2 / 9.0)).alias("chi2"), F.lit(1).alias("k"))
    return with_p_value(t, "chi2", "chi2", "k").drop("k")


@query("g10_single_values", """
WITH v AS (SELECT CAST(o_orderkey % 7 AS INT) AS g, o_totalprice AS x FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey = 7),
e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v), s AS (SELECT g, COUNT(*) AS n, STDDEV_SAMP(x) * POWER(COUNT(*), -0.2) AS h FROM v GROUP BY g)
SELECT g, CAST(i AS INT) AS point, ROUND(lo + (hi - lo) * i / 4, 4) AS x, ROUND(1000 * SUM(EXP(-0.5 * POWER((lo + (hi - lo) * i / 4 - v.x) / h, 2))
  / (n * h * SQRT(2 * PI()))), 6) AS density FROM v JOIN s USING (g), e, range(5) t(i) GROUP BY g, i, lo, hi""")
def g10b(spark, d):
    v = table(spark, d, "orders").filter("o_orderkey % 7 > 0 OR o_orderkey = 7").select(
        (F.col("o_orderkey") % 7).cast("int").alias("g"), F.col("o_totalprice").alias("x"))
    k = stats.kde(v.withColumnRenamed("x", "value"), "value", ("g",), grid=5)
    return k.withColumns({"x": F.round("x", 4), "density": F.col("density") * 1000})


@query("g12_t_tail_low_df", """
WITH v AS (SELECT DISTINCT l_linenumber, l_discount, l_linenumber / 2.0 AS t, 1.01 + l_discount * 9 AS df FROM lineitem),
w AS (SELECT *, SQRT(PI() / 2 - ATAN(t / SQRT(df))) AS top, EXP(LGAMMA((df + 1) / 2) - LGAMMA(df / 2)) / SQRT(PI()) AS c FROM v)
SELECT l_linenumber, ROUND(l_discount, 6) AS l_discount, ROUND(2 * c * top / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * POWER(SIN(POWER(top * i / 2000, 2)), df - 1) * 2 * top * i / 2000)), 6) + 0.0 AS p FROM w""")
def g12c(spark, d):
    v = table(spark, d, "lineitem").select("l_linenumber", "l_discount").distinct()
    return with_p_value(v.withColumns({"t": F.col("l_linenumber") / 2, "df": 1.01 + F.col("l_discount") * 9}), "t", "t", "df").drop("t", "df")


@query("g12_chi_square_fractional", """
WITH v AS (SELECT DISTINCT l_linenumber, l_discount, l_linenumber * 1.0 AS x, 2.3 + l_discount * 20 AS k FROM lineitem)
SELECT l_linenumber, ROUND(l_discount, 6) AS l_discount, ROUND(1 - SQRT(x) / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * 2 * POWER(SQRT(x) * i / 2000, k - 1)
  * EXP(-0.5 * POWER(SQRT(x) * i / 2000, 2)))) / (POWER(2, k / 2) * EXP(LGAMMA(k / 2))), 6) + 0.0 AS p FROM v""")
def g12d(spark, d):
    v = table(spark, d, "lineitem").select("l_linenumber", "l_discount").distinct()
    return with_p_value(v.withColumns({"x": F.col("l_linenumber") * 1.0, "k": 2.3 + F.col("l_discount") * 20}), "x", "chi2", "k").drop("x", "k")


# ---- event tables ---------------------------------------------------------------------------------

_EVENTS = """
lastw AS (SELECT subject_id, MAX(week) AS last_week FROM fx_measurement GROUP BY 1),
ev AS (SELECT subject_id, sex, overall_diet, nursing_diet, CAST({c} < 80 AS INT) AS event,
  CAST(CASE WHEN {c} < 80 THEN {c} - 4 ELSE COALESCE(round_even(date_diff('day', birth_date, death_date) / 7 - 4, 0),
  last_week - 4) END AS INT) AS event_time FROM fx_onset LEFT JOIN lastw USING (subject_id))"""
_EV300 = _EVENTS.format(c="rbg300")


def _events(m, o, keep=("sex",)):
    return O.event_table(o, m, onset="rbg300", keep=keep)


@query("x1_event_table", f"WITH {_EV300} SELECT subject_id, sex, event, event_time FROM ev")
def x1(spark, d):
    return _events(*panel(spark, d))


def _long_events(spark, d):
    """The panel with its event columns, and the onset table."""
    m, o = panel(spark, d)
    return O.longitudinal_events(m, _events(m, o)), o


@query("x2_longitudinal_events", f"""
WITH {_EV300} SELECT subject_id, week - 4 AS week, weight, rbg, diet, sex, event, event_time
FROM fx_measurement JOIN ev USING (subject_id)""")
def x2(spark, d):
    return _long_events(spark, d)[0]


# Duration and event by maternal diet; onset of 300 as that leaves subjects without it
_COX = """
ci AS (SELECT subject_id, sex, CASE WHEN rbg300 <= 20 THEN rbg300 ELSE 80 END AS rbg300,
  CASE nursing_diet WHEN 'Rab' THEN 1 WHEN 'Rod' THEN 0 END AS diet, CAST(rbg300 <= 20 AS INT) AS event,
  CASE WHEN rbg300 <= 20 THEN rbg300 ELSE 20 END AS duration FROM fx_onset WHERE overall_diet = 'Rod')"""


def _cox_input(spark, d):
    return O.cox_input(O.cohort(onset(spark, d), overall_diet="Rod"), limit=20, onset="rbg300")


@query("x3_cox_input", f"WITH {_COX} SELECT * FROM ci")
def x3(spark, d):
    return _cox_input(spark, d)


# Newton's method on the Efron likelihood with one 0/1 covariate, by sex: one list entry per death
_NEWTON = _COX + """,
tm AS (SELECT sex, duration, COUNT(*) FILTER (event = 1) AS d, COUNT(*) FILTER (event = 1 AND diet = 1) AS d1,
  COUNT(*) AS n, COUNT(*) FILTER (diet = 1) AS n1 FROM ci GROUP BY 1, 2),
rk AS (SELECT sex, duration, d, d1, SUM(n) OVER w AS r, SUM(n1) OVER w AS r1 FROM tm
  WINDOW w AS (PARTITION BY sex ORDER BY duration DESC)),
fr AS (SELECT sex, CAST(r - r1 - l / d * (d - d1) AS DOUBLE) AS a0, CAST(r1 - l / d * d1 AS DOUBLE) AS a1
  FROM (SELECT *, UNNEST(range(d)) AS l FROM rk WHERE d > 0)),
pk AS (SELECT sex, list(struct_pack(a0 := a0, a1 := a1)) AS f FROM fr GROUP BY sex),
dd AS (SELECT sex, CAST(SUM(d1) AS DOUBLE) AS sum_d1, AVG(diet) AS m FROM tm JOIN (SELECT sex, AVG(diet) AS diet FROM ci GROUP BY sex)
  USING (sex) GROUP BY sex),
nw AS (SELECT sex, 0 AS i, CAST(0 AS DOUBLE) AS b FROM pk UNION ALL
  SELECT nw.sex, i + 1, b + (sum_d1 - list_sum(list_transform(f, lambda x: x.a1 * EXP(b) / (x.a0 + x.a1 * EXP(b)))))
    / list_sum(list_transform(f, lambda x: x.a1 * EXP(b) * x.a0 / POWER(x.a0 + x.a1 * EXP(b), 2)))
  FROM nw JOIN pk ON pk.sex = nw.sex JOIN dd ON dd.sex = nw.sex WHERE i < 15),
fit AS (SELECT nw.sex, b, 1 / SQRT(list_sum(list_transform(f, lambda x: x.a1 * EXP(b) * x.a0 / POWER(x.a0 + x.a1 * EXP(b), 2)))) AS se, m
  FROM nw JOIN pk ON pk.sex = nw.sex JOIN dd ON dd.sex = nw.sex WHERE i = 15)"""


def _cox_by_sex(spark, d):
    """The cohort and the models of both sexes, fitted side by side."""
    rows = materialize(_cox_input(spark, d))
    return rows, cox_fits(rows, "duration", "event", ["diet"], "sex")


@query("x4_cox_risk_sets", f"""
WITH {_COX}, t AS (SELECT sex, duration, COUNT(*) AS n, SUM(event) AS d FROM ci GROUP BY 1, 2)
SELECT sex, duration AS time, CAST(SUM(n) OVER (PARTITION BY sex ORDER BY duration DESC) AS BIGINT) AS at_risk,
  CAST(d AS BIGINT) AS deaths, CAST(n - d AS BIGINT) AS lost FROM t""")
def x4(spark, d):
    return risk_sets(_cox_input(spark, d), "duration", "event", ("sex",))


@query("x4_cox_by_sex", f"WITH RECURSIVE {_NEWTON} SELECT sex, 'diet' AS covariate, ROUND(b, 6) AS coef FROM fit")
def x4b(spark, d):
    return _cox_by_sex(spark, d)[1].summary().select("sex", "covariate", "coef")


@query("x5_cox_summary", f"""
WITH RECURSIVE {_NEWTON} SELECT sex, 'diet' AS covariate, ROUND(b, 6) AS coef, ROUND(se, 6) AS se, ROUND(EXP(b), 6) AS hazard_ratio,
  ROUND(b / se, 6) AS z, ROUND(EXP(b - 1.959963984540054 * se), 6) AS lower, ROUND(EXP(b + 1.959963984540054 * se), 6) AS upper,
  ROUND({_Z_TAIL.format(z="(b / se)")}, 6) AS p FROM fit""")
def x5(spark, d):
    return _cox_by_sex(spark, d)[1].summary()


@query("x6_relative_hazard", f"""
WITH RECURSIVE {_NEWTON} SELECT subject_id, sex, ROUND(b * (diet - m), 6) + 0.0 AS lp, ROUND(EXP(b * (diet - m)), 6) AS partial_hazard
FROM ci JOIN fit USING (sex)""")
def x6(spark, d):
    rows, models = _cox_by_sex(spark, d)
    return models.transform(rows).select("subject_id", "sex", "lp", "partial_hazard")


def with_litter_size(rows, subjects):
    """Litter sizes of known mothers; a subject with an unknown mother (null or -1) is a litter of its own, of size 1."""
    litter = subjects.filter("mother <> -1").groupBy("mother").agg(F.count(F.lit(1)).alias("litter_size"))
    return rows.join(litter, "mother", "left").withColumn("litter_size", F.coalesce("litter_size", F.lit(1)))


@query("x4_cox_formula")
def x4c(spark, d):
    """Several covariates: sex, diet and the size of the litter."""
    m, o = panel(spark, d)
    o = materialize(o)
    rows = with_litter_size(_events(m, o, ("sex", "nursing_diet", "mother")), o)
    coded = rows.withColumns({"sex": encode_map("sex", {"F": 0, "M": 1}), "diet": encode_map("nursing_diet", {"Rab": 0, "Rod": 1})})
    return cox_ph(coded, "event_time", "event", ["sex", "diet", "litter_size"]).summary()


# marker: the week-4 reading; event time of the 300 crossing
_MARK = _EV300 + ", mk AS (SELECT e.subject_id, event, event_time, rbg4, wt4 FROM ev e JOIN fx_wide USING (subject_id) WHERE rbg4 IS NOT NULL)"


def _marked(spark, d):
    m, o = panel(spark, d)
    return _events(m, o).join(_wide(m).select("subject_id", "rbg4", "wt4"), "subject_id").filter("rbg4 IS NOT NULL")


@query("x7_concordance", f"""
WITH {_MARK}, p AS (SELECT SUM(CASE WHEN a.rbg4 > b.rbg4 THEN 1.0 ELSE 0 END) AS con, SUM(CASE WHEN a.rbg4 = b.rbg4 THEN 1.0 ELSE 0 END) AS tie,
  COUNT(*) AS cmp FROM mk a JOIN mk b ON a.event = 1 AND (b.event_time > a.event_time OR (b.event_time = a.event_time AND b.event = 0)))
SELECT CAST(con AS DOUBLE) AS concordant, CAST(tie AS DOUBLE) AS tied, CAST(cmp AS DOUBLE) AS comparable,
  ROUND((con + 0.5 * tie) / cmp, 6) AS c_index FROM p""")
def x7(spark, d):
    return concordance(_marked(spark, d), "event_time", "event", "rbg4")


_KM = """
kt AS (SELECT event_time, COUNT(*) AS n, SUM(event) AS d FROM mk GROUP BY 1),
kr AS (SELECT event_time, d, n - d AS c, SUM(n) OVER (ORDER BY event_time DESC) AS r FROM kt),
kf AS (SELECT *, CASE WHEN r - d > 0 THEN 1 - CAST(c AS DOUBLE) / (r - d) ELSE 1.0 END AS f FROM kr),
km AS (SELECT event_time, r, d, c, PRODUCT(f) OVER (ORDER BY event_time) AS g,
  COALESCE(PRODUCT(f) OVER (ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS gb FROM kf)"""


@query("x8_censoring_curve", f"""
WITH {_MARK}, {_KM} SELECT CAST(event_time AS INT) AS time, CAST(r AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS deaths,
  CAST(c AS BIGINT) AS lost, ROUND(g, 6) AS g, ROUND(gb, 6) AS g_before FROM km""")
def x8b(spark, d):
    return censoring_curve(_marked(spark, d), "event_time", "event")


_TIMES = (4, 8, 12, 16, 20, 24, 28, 32)


@query("x8_time_dependent_auc", f"""
WITH {_MARK}, {_KM}, ts AS (SELECT UNNEST({list(_TIMES)}) AS t),
ca AS (SELECT t, rbg4, 1 / gb AS w FROM mk JOIN km USING (event_time), ts WHERE event = 1 AND event_time <= t),
co AS (SELECT t, rbg4 FROM mk, ts WHERE event_time > t),
pr AS (SELECT ca.t, SUM(w * CASE WHEN ca.rbg4 > co.rbg4 THEN 1.0 WHEN ca.rbg4 = co.rbg4 THEN 0.5 ELSE 0 END) AS win
  FROM ca JOIN co ON ca.t = co.t GROUP BY 1),
sc AS (SELECT t, COUNT(*) AS n, SUM(w) AS w FROM ca GROUP BY t), sn AS (SELECT t, COUNT(*) AS n FROM co GROUP BY t)
SELECT CAST(ts.t AS DOUBLE) AS t, COALESCE(sc.n, 0) AS n_cases, COALESCE(sn.n, 0) AS n_controls,
  ROUND(win / (sc.w * sn.n), 6) AS auc
FROM ts LEFT JOIN pr USING (t) LEFT JOIN sc USING (t) LEFT JOIN sn USING (t)""")
def x8(spark, d):
    return td_auc(_marked(spark, d), "event_time", "event", "rbg4", _TIMES)


@query("x8_auc_all_event_times", f"""
WITH {_MARK}, {_KM}, ts AS (SELECT DISTINCT event_time AS t FROM mk WHERE event_time >= (SELECT MIN(event_time) FROM mk WHERE event = 1)),
ca AS (SELECT t, rbg4, 1 / gb AS w FROM mk JOIN km USING (event_time), ts WHERE event = 1 AND event_time <= t),
co AS (SELECT t, rbg4 FROM mk, ts WHERE event_time > t),
pr AS (SELECT ca.t, SUM(w * CASE WHEN ca.rbg4 > co.rbg4 THEN 1.0 WHEN ca.rbg4 = co.rbg4 THEN 0.5 ELSE 0 END) AS win
  FROM ca JOIN co ON ca.t = co.t GROUP BY 1),
sc AS (SELECT t, COUNT(*) AS n, SUM(w) AS w FROM ca GROUP BY t), sn AS (SELECT t, COUNT(*) AS n FROM co GROUP BY t)
SELECT CAST(ts.t AS DOUBLE) AS t, COALESCE(sc.n, 0) AS n_cases, COALESCE(sn.n, 0) AS n_controls, ROUND(win / (sc.w * sn.n), 6) AS auc
FROM ts LEFT JOIN pr USING (t) LEFT JOIN sc USING (t) LEFT JOIN sn USING (t)""")
def x8c(spark, d):
    return td_auc_all_times(_marked(spark, d), "event_time", "event", "rbg4")


# the same within each sex, all sexes in one run
_MARK_SEX = _EV300 + ", mk AS (SELECT e.sex, event, event_time, rbg4 FROM ev e JOIN fx_wide USING (subject_id) WHERE rbg4 IS NOT NULL)"


def _marked_by_sex(spark, d):
    m, o = panel(spark, d)
    return _events(m, o).join(_wide(m).select("subject_id", "rbg4"), "subject_id").filter("rbg4 IS NOT NULL")


@query("x7_concordance_by_sex", f"""
WITH {_MARK_SEX}, p AS (SELECT a.sex, SUM(CASE WHEN a.rbg4 > b.rbg4 THEN 1.0 ELSE 0 END) AS con, SUM(CASE WHEN a.rbg4 = b.rbg4 THEN 1.0 ELSE 0 END) AS tie,
  COUNT(*) AS cmp FROM mk a JOIN mk b ON a.sex = b.sex AND a.event = 1
    AND (b.event_time > a.event_time OR (b.event_time = a.event_time AND b.event = 0)) GROUP BY a.sex)
SELECT sex, CAST(con AS DOUBLE) AS concordant, CAST(tie AS DOUBLE) AS tied, CAST(cmp AS DOUBLE) AS comparable,
  ROUND((con + 0.5 * tie) / cmp, 6) AS c_index FROM p""")
def x7b(spark, d):
    return concordance(_marked_by_sex(spark, d), "event_time", "event", "rbg4", ("sex",))


@query("x8_auc_all_times_by_sex", f"""
WITH {_MARK_SEX},
kt AS (SELECT sex, event_time, COUNT(*) AS n, SUM(event) AS d FROM mk GROUP BY 1, 2),
kr AS (SELECT sex, event_time, d, n - d AS c, SUM(n) OVER (PARTITION BY sex ORDER BY event_time DESC) AS r FROM kt),
kf AS (SELECT *, CASE WHEN r - d > 0 THEN 1 - CAST(c AS DOUBLE) / (r - d) ELSE 1.0 END AS f FROM kr),
km AS (SELECT sex, event_time, COALESCE(PRODUCT(f) OVER (PARTITION BY sex ORDER BY event_time
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS gb FROM kf),
ts AS (SELECT DISTINCT sex, event_time AS t FROM mk m WHERE event_time >= (SELECT MIN(event_time) FROM mk k WHERE event = 1 AND k.sex = m.sex)),
ca AS (SELECT ts.sex, t, rbg4, 1 / gb AS w FROM mk JOIN km USING (sex, event_time) JOIN ts USING (sex) WHERE event = 1 AND event_time <= t),
co AS (SELECT ts.sex, t, rbg4 FROM mk JOIN ts USING (sex) WHERE event_time > t),
pr AS (SELECT ca.sex, ca.t, SUM(w * CASE WHEN ca.rbg4 > co.rbg4 THEN 1.0 WHEN ca.rbg4 = co.rbg4 THEN 0.5 ELSE 0 END) AS win
  FROM ca JOIN co ON ca.t = co.t AND ca.sex = co.sex GROUP BY 1, 2),
sc AS (SELECT sex, t, COUNT(*) AS n, SUM(w) AS w FROM ca GROUP BY 1, 2), sn AS (SELECT sex, t, COUNT(*) AS n FROM co GROUP BY 1, 2)
SELECT sex, CAST(ts.t AS DOUBLE) AS t, COALESCE(sc.n, 0) AS n_cases, COALESCE(sn.n, 0) AS n_controls, ROUND(win / (sc.w * sn.n), 6) AS auc
FROM ts LEFT JOIN pr USING (sex, t) LEFT JOIN sc USING (sex, t) LEFT JOIN sn USING (sex, t)""")
def x8d(spark, d):
    return td_auc_all_times(_marked_by_sex(spark, d), "event_time", "event", "rbg4", ("sex",))


_CENSORED_COX = """
hz AS (SELECT sex, duration, event, diet, EXP(b * (diet - m)) AS h FROM ci JOIN fit USING (sex)),
ht AS (SELECT sex, duration, SUM(event) AS d, COUNT(*) AS n, SUM(h) AS hs FROM hz GROUP BY 1, 2),
h0 AS (SELECT sex, duration, SUM(d / r) OVER (PARTITION BY sex ORDER BY duration) AS ch FROM (
  SELECT sex, duration, d, SUM(hs) OVER (PARTITION BY sex ORDER BY duration DESC) AS r FROM ht)),
gr AS (SELECT sex, duration, d, n - d AS c, SUM(n) OVER (PARTITION BY sex ORDER BY duration DESC) AS r FROM ht),
gf AS (SELECT sex, duration, CASE WHEN r - d > 0 THEN 1 - CAST(c AS DOUBLE) / (r - d) ELSE 1.0 END AS f FROM gr),
gk AS (SELECT sex, duration, PRODUCT(f) OVER (PARTITION BY sex ORDER BY duration) AS g, COALESCE(PRODUCT(f) OVER (
  PARTITION BY sex ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS gb FROM gf),
ts AS (SELECT sex, t FROM (SELECT DISTINCT sex FROM hz), (SELECT UNNEST([4, 8, 12, 16]) AS t)),
bt AS (SELECT sex, t, (SELECT MAX(ch) FROM h0 WHERE duration <= t AND h0.sex = ts.sex) AS ch,
  (SELECT MIN(g) FROM gk WHERE duration <= t AND gk.sex = ts.sex) AS g FROM ts),
br AS (SELECT hz.sex, t, AVG(CASE WHEN event = 1 AND duration <= t THEN POWER(EXP(-COALESCE(ch, 0) * h), 2) / gb
  WHEN duration > t THEN POWER(1 - EXP(-COALESCE(ch, 0) * h), 2) / COALESCE(bt.g, 1) ELSE 0 END) AS brier
  FROM hz JOIN gk USING (sex, duration) JOIN bt ON bt.sex = hz.sex GROUP BY 1, 2)"""


def _brier(spark, d):
    """Scores of the model of each sex."""
    rows, models = _cox_by_sex(spark, d)
    return _by_sex({sex: brier(rows.filter(F.col("sex") == sex), m, "duration", "event", (4, 8, 12, 16)) for sex, m in models.models.items()})


def _by_sex(tables):
    parts = [t.select(F.lit(sex).alias("sex"), "*") for sex, t in tables.items()]
    return parts[0].unionByName(parts[1])


@query("x9_brier_score", f"""
WITH RECURSIVE {_NEWTON}, {_CENSORED_COX} SELECT sex, CAST(t AS DOUBLE) AS t, ROUND(brier, 6) AS brier FROM br""")
def x9(spark, d):
    return _brier(spark, d)


@query("x9_integrated_brier", f"""
WITH RECURSIVE {_NEWTON}, {_CENSORED_COX}, st AS (SELECT sex, t, (brier + LAG(brier) OVER (PARTITION BY sex ORDER BY t)) / 2
  * (t - LAG(t) OVER (PARTITION BY sex ORDER BY t)) AS a FROM br)
SELECT sex, ROUND(SUM(a) / (MAX(t) - MIN(t)), 6) AS ibs FROM st GROUP BY sex""")
def x9b(spark, d):
    return integrated_brier(_brier(spark, d), ("sex",))


#: The same scores at every time of the cohort, as in the study.
_CENSORED_COX_ALL = _CENSORED_COX.replace(
    "(SELECT sex, t FROM (SELECT DISTINCT sex FROM hz), (SELECT UNNEST([4, 8, 12, 16]) AS t))", "(SELECT DISTINCT sex, duration AS t FROM hz)")


def _brier_all(spark, d):
    rows, models = _cox_by_sex(spark, d)
    return brier_all_times(rows, models, "duration", "event")


@query("x9_brier_all_event_times", f"""
WITH RECURSIVE {_NEWTON}, {_CENSORED_COX_ALL} SELECT sex, CAST(t AS DOUBLE) AS t, ROUND(brier, 6) AS brier FROM br""")
def x9c(spark, d):
    return _brier_all(spark, d)


@query("x9_integrated_brier_all_event_times", f"""
WITH RECURSIVE {_NEWTON}, {_CENSORED_COX_ALL}, st AS (SELECT sex, t, (brier + LAG(brier) OVER (PARTITION BY sex ORDER BY t)) / 2
  * (t - LAG(t) OVER (PARTITION BY sex ORDER BY t)) AS a FROM br)
SELECT sex, ROUND(SUM(a) / (MAX(t) - MIN(t)), 6) AS ibs FROM st GROUP BY sex""")
def x9d(spark, d):
    return integrated_brier(_brier_all(spark, d), ("sex",))


def _longitudinal(spark, d):
    """Coded rows for the mixed model."""
    kept = materialize(longitudinal_cohort(*_long_events(spark, d)))
    sex, = index_categories(kept, [kept], "sex")
    return index_categories(sex, [sex], "diet")[0]


_FIXED = ("weight", "week", "sex", "diet")


@query("x10_mixed_model")
def x10(spark, d):
    return mixed_model(_longitudinal(spark, d), "rbg", _FIXED, ("weight", "week"), "subject_id").summary()


@query("x11_mixed_predictions")
def x11(spark, d):
    rows = _longitudinal(spark, d)
    model = mixed_model(rows, "rbg", _FIXED, ("weight", "week"), "subject_id")
    return model.transform(rows, with_random=True).groupBy("subject_id").agg(F.avg("rbg").alias("rbg"), F.avg("pred").alias("pred"))


_COHORT = f"""{_EV300}, r AS (SELECT subject_id, week - 4 AS week, weight, rbg, m.diet, ev.sex, event, event_time, nursing_diet
  FROM fx_measurement m JOIN ev USING (subject_id) WHERE overall_diet = 'Rod' AND nursing_diet IN ('Rab', 'Rod')
  AND weight IS NOT NULL AND rbg IS NOT NULL AND event_time IS NOT NULL),
lc AS (SELECT subject_id, week, weight, rbg, sex, event, event_time, nursing_diet AS diet FROM r
  WHERE subject_id IN (SELECT subject_id FROM r GROUP BY 1 HAVING COUNT(*) > 1) AND diet IN ('Rod', 'Rab'))"""


@query("x11_longitudinal_cohort", f"WITH {_COHORT} SELECT * FROM lc")
def x11b(spark, d):
    return longitudinal_cohort(*_long_events(spark, d))


# Intercept, weight and week; variances of their effects of each subject; residual variance. Round numbers near a fit.
_AT = {"coef": (150.0, 2.0, 1.0), "variances": (400.0, 0.5, 0.25), "sigma2": 2500.0}


def _likelihood_sql() -> str:
    """The likelihood of each subject in closed form: inverse and determinant of its matrix of three rows."""
    (b0, b1, b2), (v0, v1, v2), s2 = _AT["coef"], _AT["variances"], _AT["sigma2"]
    return f"""
WITH {_COHORT},
z AS (SELECT subject_id, 1.0::DOUBLE AS one, weight::DOUBLE AS x, week::DOUBLE AS w,
  rbg::DOUBLE - {b0} - {b1}::DOUBLE * weight - {b2}::DOUBLE * week AS e FROM lc),
s AS (SELECT subject_id, COUNT(*) AS n, SUM(one) + {s2 / v0}::DOUBLE AS a, SUM(x) AS b, SUM(w) AS c, SUM(x * x) + {s2 / v1}::DOUBLE AS d,
  SUM(x * w) AS f, SUM(w * w) + {s2 / v2}::DOUBLE AS g, SUM(e) AS p, SUM(x * e) AS q, SUM(w * e) AS r, SUM(e * e) AS ee FROM z GROUP BY 1),
t AS (SELECT *, a * (d * g - f * f) - b * (b * g - c * f) + c * (b * f - c * d) AS det,
  p * p * (d * g - f * f) + q * q * (a * g - c * c) + r * r * (a * d - b * b)
  + 2 * (p * q * (c * f - b * g) + p * r * (b * f - c * d) + q * r * (b * c - a * f)) AS adj FROM s)
SELECT subject_id, n, ROUND(-0.5 * (n * LN(2 * PI()) + (n - 3) * LN({s2}::DOUBLE) + LN({v0 * v1 * v2}::DOUBLE) + LN(det) + (ee - adj / det) / {s2}::DOUBLE), 4)
  AS loglik FROM t"""


@query("x10_subject_likelihoods", _likelihood_sql(), digits=4)
def x10b(spark, d):
    """The likelihood that the mixed model maximises, of each subject at stated parameters."""
    diagonal = [[v if i == j else 0.0 for j in range(3)] for i, v in enumerate(_AT["variances"])]
    return subject_likelihoods(longitudinal_cohort(*_long_events(spark, d)), "rbg", ("weight", "week"), ("weight", "week"), "subject_id",
                               _AT["coef"], diagonal, _AT["sigma2"])


@query("x12_regression_error", """
SELECT diet, ROUND(SQRT(AVG(POWER(rbg - weight, 2))), 6) AS rmse, ROUND(AVG(ABS(rbg - weight)), 6) AS mae
FROM fx_measurement GROUP BY diet""")
def x12(spark, d):
    return regression_error(measurements(spark, d), "rbg", "weight", ("diet",))


@query("x13_subject_rows", f"""
WITH {_EV300} SELECT subject_id, event_time, event, sex FROM ev WHERE subject_id IN (SELECT subject_id FROM fx_measurement)""")
def x13(spark, d):
    return subject_rows(_long_events(spark, d)[0])


@query("x14_fold_by_subject", """
SELECT subject_id, week, CAST(CAST(('0x' || substr(md5('42:' || CAST(subject_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INT) AS fold
FROM fx_measurement""")
def x14(spark, d):
    return fold_by_subject(measurements(spark, d).select("subject_id", "week"), "subject_id")


@query("x15_cross_validation")
def x15(spark, d):
    kept = materialize(longitudinal_cohort(*_long_events(spark, d)))
    return cross_validate_survival(kept)


@query("x4_incidence_group_sizes", f"""
WITH k AS (SELECT * FROM fx_onset WHERE overall_diet = 'Rod' AND weanling_diet = 'Rod' AND nursing_diet = gestational_diet
  AND (rbg200 <= 40 OR date_diff('day', birth_date, death_date) >= 280))
SELECT sex, COUNT(*) AS n FROM k GROUP BY sex""")
def x4d(spark, d):
    return incidence_by_diet(onset(spark, d), drop_week=None).groupBy("sex").agg(F.sum("count").alias("n"))
