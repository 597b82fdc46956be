"""Feature tables, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query
from cohortline.catalog.views import onset, panel
from cohortline.operators.evaluate import (
    classification_report, cohort_counts, feature_auc, feature_roc, roc_auc, roc_curve, score_summary)
from cohortline.operators.folds import split, split_flag, stratified_folds
from cohortline.operators.lineage import lineage_features
from cohortline.operators.neighbours import knn_classify
from cohortline.plans.features import feature_table, risk_table, with_label
from cohortline.plans.models import coefficients, fit_model, importances, tree_rules
from cohortline.plans.selection import (
    compare_models, comparison_table, feature_sweep, grid_search, rfe_cv, tuned_report)
from cohortline.plans.settings import FULL_COMPARISON, LINEAGE_FOREST_GRID, TREE_GRID
from cohortline.session import materialize

# The label is onset of 300 by week 12: both classes are common and no feature decides it alone.
CUTOFF = 12
FEATURES = ["wt4", "wt8", "rbg4", "rbg8"]
KEEP = ("mother", "father", "sex", "rbg200", "rbg300")

_FT = """
ft AS (SELECT subject_id, mother, father, sex, rbg200, rbg300, gestational_diet IN ('Rod', 'New') AS gestational_diet,
  nursing_diet IN ('Rod', 'New') AS nursing_diet, weanling_diet IN ('Rod', 'New') AS weanling_diet,
  wt4, wt8, wt12, rbg4, rbg8, rbg12, wt8 - wt4 AS diff48, CAST(rbg300 <= 12 AS INT) AS label
  FROM fx_wide JOIN fx_onset USING (subject_id))"""
_COMPLETE = _FT + """,
cf AS (SELECT * FROM ft WHERE wt4 IS NOT NULL AND wt8 IS NOT NULL AND rbg4 IS NOT NULL AND rbg8 IS NOT NULL)"""


def _hash(seed: int, key: str = "subject_id") -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


_SPLIT = f"{_hash(888)} < CAST(FLOOR(0.2 * 4294967296) AS BIGINT)"


def _features(spark, d, weeks=(4, 8, 12)):
    return with_label(feature_table(*panel(spark, d), weeks, keep=KEEP), CUTOFF, onset="rbg300")


def _complete(spark, d):
    return _features(spark, d).dropna(subset=FEATURES)


@query("m1_feature_table", f"WITH {_FT} SELECT * FROM ft")
def m1(spark, d):
    return _features(spark, d)


@query("m1_feature_table_all", """
SELECT subject_id, sex, rbg200, gestational_diet IN ('Rod') AS gestational_diet, nursing_diet IN ('Rod') AS nursing_diet, wt4, wt8, rbg4, rbg8
FROM (SELECT * FROM fx_wide WHERE wt4 IS NOT NULL OR wt8 IS NOT NULL OR rbg4 IS NOT NULL OR rbg8 IS NOT NULL)
FULL JOIN fx_onset USING (subject_id)""")
def m1b(spark, d):
    return feature_table(*panel(spark, d), (4, 8), diets=("gestational_diet", "nursing_diet"),
                         diet_values=("Rod",), keep=("sex", "rbg200"), how="outer").drop("diff48")


_LINEAGE = """
own AS (SELECT *, CASE WHEN rbg200 <= CASE sex WHEN 'M' THEN 4 ELSE 8 END THEN 1 ELSE 0 END AS own FROM {src}),
lin AS (SELECT a.*, COALESCE(m.rbg200 <= 8, FALSE) AS rbg200_mo, COALESCE(f.rbg200 <= 4, FALSE) AS rbg200_fa,
  CASE WHEN EXISTS (SELECT 1 FROM own b WHERE b.mother = a.mother AND b.subject_id <> a.subject_id AND b.own = 1)
    THEN 1 ELSE 0 END AS rbg200_sib
  FROM own a LEFT JOIN fx_onset m ON m.subject_id = a.mother LEFT JOIN fx_onset f ON f.subject_id = a.father)"""
_CUTS = {"M": 4, "F": 8}


@query("m2_lineage_features", f"""
WITH {_FT}, {_LINEAGE.format(src="ft")}
SELECT subject_id, rbg200_mo, rbg200_fa, rbg200_sib, rbg200_mo OR rbg200_fa OR rbg200_sib = 1 AS family_history FROM lin""")
def m2(spark, d):
    m, o = panel(spark, d)
    o = materialize(o)
    out = lineage_features(materialize(feature_table(m, o, keep=KEEP)), o, _CUTS)
    return out.select("subject_id", "rbg200_mo", "rbg200_fa", "rbg200_sib", "family_history")


@query("m2_risk_table", f"""
WITH {_FT}, el AS (SELECT ft.* FROM ft JOIN fx_onset o USING (subject_id) WHERE o.overall_diet = 'Rod' AND (
  ft.rbg200 <= CASE ft.sex WHEN 'M' THEN 4 ELSE 8 END
  OR date_diff('day', o.birth_date, o.death_date) >= 7 * CASE ft.sex WHEN 'M' THEN 4 ELSE 8 END)),
{_LINEAGE.format(src="el")}
SELECT subject_id, sex, wt4, wt8, rbg4, rbg8, family_history, label FROM (
  SELECT *, rbg200_mo OR rbg200_fa OR rbg200_sib = 1 AS family_history, own AS y FROM lin) t
JOIN (SELECT subject_id AS sid, own AS label2 FROM own) ON sid = subject_id
WHERE wt4 IS NOT NULL AND wt8 IS NOT NULL AND rbg4 IS NOT NULL AND rbg8 < 200""".replace(
    "family_history, label FROM", "family_history, y AS label FROM"))
def m2b(spark, d):
    m, o = panel(spark, d)
    out = risk_table(m, materialize(o), _CUTS, FEATURES)
    return out.select("subject_id", "sex", *FEATURES, "family_history", "label")


@query("m3_label", """
SELECT subject_id, CAST(rbg300 <= 24 AS INT) AS label, CAST(rbg300 <= CASE sex WHEN 'M' THEN 16 ELSE 36 END AS INT) AS label_by_sex
FROM fx_onset""")
def m3(spark, d):
    out = with_label(onset(spark, d), 24, onset="rbg300")
    return with_label(out, {"M": 16, "F": 36}, "label_by_sex", "rbg300").select("subject_id", "label", "label_by_sex")


@query("m4_split", f"SELECT subject_id, sex, {_SPLIT} AS is_test FROM fx_main")
def m4(spark, d):
    return split_flag(onset(spark, d).select("subject_id", "sex"), "subject_id")


@query("m4_split_sizes", f"""
WITH {_COMPLETE}, s AS (SELECT {_SPLIT} AS t, label FROM cf)
SELECT 'train' AS part, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positives FROM s WHERE NOT t
UNION ALL SELECT 'test', COUNT(*), CAST(SUM(label) AS BIGINT) FROM s WHERE t""")
def m4b(spark, d):
    train, test = split(_complete(spark, d), "subject_id")
    sized = [cohort_counts(x, "label").select(F.lit(n).alias("part"), "n", "positives") for n, x in (("train", train), ("test", test))]
    return sized[0].unionByName(sized[1])


@query("m5_stratified_folds", f"""
WITH {_COMPLETE} SELECT subject_id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY {_hash(42)}, subject_id) - 1) % 5 AS INT) AS fold
FROM cf""")
def m5(spark, d):
    return stratified_folds(_complete(spark, d).select("subject_id", "label"), "subject_id", "label", 5)


@query("m5_grid_search")
def m5b(spark, d):
    rows = materialize(_complete(spark, d).select("subject_id", "label", *FEATURES))
    return grid_search(rows, "tree", FEATURES, TREE_GRID)[1]


_KNN = """
tr AS (SELECT * FROM cf WHERE NOT ({split})), te AS (SELECT * FROM cf WHERE {split}),
di AS (SELECT te.subject_id, tr.subject_id AS nb, tr.label, {dist} AS dist FROM te, tr),
nn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dist, nb) AS rk FROM di),
k5 AS (SELECT *, MIN(dist) OVER (PARTITION BY subject_id) AS md FROM nn WHERE rk <= {k}),
vo AS (SELECT subject_id, SUM(CASE WHEN label = 1 THEN w ELSE 0 END) AS v1, SUM(w) AS v FROM (SELECT *, {weight} AS w FROM k5) GROUP BY 1)
SELECT subject_id, CASE WHEN v1 > v - v1 THEN 1 ELSE 0 END AS prediction, ROUND(v1 / v, 6) AS probability FROM vo"""
_L1 = " + ".join(f"ABS(te.{f} - tr.{f})" for f in FEATURES)
_L2 = "SQRT(" + " + ".join(f"POWER(te.{f} - tr.{f}, 2)" for f in FEATURES) + ")"


@query("m6_knn_uniform", f"WITH {_COMPLETE}, {_KNN.format(split=_SPLIT, dist=_L1, k=7, weight='1.0')}")
def m6(spark, d):
    train, test = split(_complete(spark, d), "subject_id")
    return knn_classify(train, test, FEATURES, "subject_id", "label", 7, "uniform", 1)


@query("m6_knn_distance", f"""WITH {_COMPLETE}, {_KNN.format(
    split=_SPLIT, dist=_L2, k=9, weight='CASE WHEN md = 0 THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0 END ELSE 1 / dist END')}""")
def m6b(spark, d):
    train, test = split(_complete(spark, d), "subject_id")
    return knn_classify(train, test, FEATURES, "subject_id", "label", 9, "distance", 2)


@query("m6_knn_small_leaves", f"WITH {_COMPLETE}, {_KNN.format(split=_SPLIT, dist=_L2, k=5, weight='1.0')}")
def m6c(spark, d):
    train, test = split(_complete(spark, d), "subject_id")
    return knn_classify(train, test, FEATURES, "subject_id", "label", 5, "uniform", 2, leaf_rows=4, slice_rows=500)


def _trained(spark, d, family, features=FEATURES, **params):
    """A model fitted on the training rows, and the test rows."""
    rows = materialize(_complete(spark, d))
    train, test = split(rows, "subject_id")
    return fit_model(family, train, features, params=params), test


def _scored(spark, d, family, features=FEATURES, **params):
    model, test = _trained(spark, d, family, features, **params)
    return model.transform(test).select("subject_id", "label", "prediction", "probability")


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS x, CAST(rbg300 <= 8 AS INT) AS label FROM cf" for f in FEATURES)


@query("m7_decision_stump", f"""
WITH {_COMPLETE}, lg AS ({_LONG}), vc AS (SELECT f, x, COUNT(*) AS n, SUM(label) AS p FROM lg GROUP BY 1, 2),
cu AS (SELECT f, x, SUM(n) OVER (PARTITION BY f ORDER BY x) AS nl, SUM(p) OVER (PARTITION BY f ORDER BY x) AS pl,
  SUM(n) OVER (PARTITION BY f) AS nt, SUM(p) OVER (PARTITION BY f) AS pt FROM vc),
be AS (SELECT * FROM cu WHERE nl < nt ORDER BY (pl * pl + (nl - pl) * (nl - pl)) / CAST(nl AS DOUBLE)
  + ((pt - pl) * (pt - pl) + (nt - nl - pt + pl) * (nt - nl - pt + pl)) / CAST(nt - nl AS DOUBLE) DESC, f LIMIT 1)
SELECT subject_id, ROUND(CASE WHEN CASE be.f {' '.join(f"WHEN '{f}' THEN cf.{f}" for f in FEATURES)} END <= be.x
  THEN CAST(pl AS DOUBLE) / nl ELSE CAST(pt - pl AS DOUBLE) / (nt - nl) END, 6) AS probability FROM cf, be""")
def m7(spark, d):
    rows = materialize(with_label(_complete(spark, d), 8, onset="rbg300"))
    model = fit_model("tree", rows, FEATURES, params={"criterion": "gini", "max_depth": 1})
    return model.transform(rows).select("subject_id", "probability")


@query("m7_decision_tree")
def m7b(spark, d):
    return _scored(spark, d, "tree", criterion="entropy", max_depth=4)


@query("m8_random_forest")
def m8(spark, d):
    return _scored(spark, d, "forest", criterion="gini", max_depth=4, n_trees=20)


# Newton's method for one feature; the penalty enters as the gradient and curvature of b1
_LOGISTIC = _COMPLETE + """,
pt AS (SELECT list(struct_pack(x := CAST(rbg8 AS DOUBLE), y := CAST(label AS DOUBLE))) AS f FROM cf{where}),
nw AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM pt UNION ALL
  SELECT i + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT i, b0, b1, list_sum(list_transform(f, lambda r: 1 / (1 + EXP(-b0 - b1 * r.x)) - r.y)) AS g0,
      list_sum(list_transform(f, lambda r: r.x * (1 / (1 + EXP(-b0 - b1 * r.x)) - r.y))) + {grad} AS g1,
      list_sum(list_transform(f, lambda r: EXP(-b0 - b1 * r.x) / POWER(1 + EXP(-b0 - b1 * r.x), 2))) AS h00,
      list_sum(list_transform(f, lambda r: r.x * EXP(-b0 - b1 * r.x) / POWER(1 + EXP(-b0 - b1 * r.x), 2))) AS h01,
      list_sum(list_transform(f, lambda r: r.x * r.x * EXP(-b0 - b1 * r.x) / POWER(1 + EXP(-b0 - b1 * r.x), 2))) + {curve} AS h11
    FROM nw, pt) WHERE i < 15)"""


@query("m9_logistic_coefficients", f"""
WITH RECURSIVE {_LOGISTIC.format(where="", grad="b1 / 0.1", curve="1 / 0.1")}
SELECT 'rbg8' AS term, ROUND(b1, 4) AS coef FROM nw WHERE i = 15
UNION ALL SELECT 'intercept', ROUND(b0, 4) FROM nw WHERE i = 15""", digits=4)
def m9(spark, d):
    rows = materialize(_complete(spark, d))
    return coefficients(spark, fit_model("logistic", rows, ["rbg8"], params={"c": 0.1}))


_NOT_TEST = f" WHERE NOT ({_SPLIT})"


@query("m9_logistic_l2", f"""
WITH RECURSIVE {_LOGISTIC.format(where=_NOT_TEST, grad="b1 / 0.3", curve="1 / 0.3")}
SELECT subject_id, label, CAST(b0 + b1 * rbg8 > 0 AS INT) + 0.0::DOUBLE AS prediction, ROUND(1 / (1 + EXP(-b0 - b1 * rbg8)), 4) AS probability
FROM cf, nw WHERE i = 15 AND {_SPLIT}""", digits=4)
def m9b(spark, d):
    return _scored(spark, d, "logistic", features=["rbg8"], c=0.3)


@query("m9_logistic_all_features")
def m9c(spark, d):
    return _scored(spark, d, "logistic", c=0.3)


@query("m10_logistic_l1_coefficients", f"""
WITH RECURSIVE {_LOGISTIC.format(where="", grad="SIGN(b1) / 0.1", curve="0")}
SELECT 'rbg8' AS term, ROUND(b1, 4) AS coef FROM nw WHERE i = 15
UNION ALL SELECT 'intercept', ROUND(b0, 4) FROM nw WHERE i = 15""", digits=4)
def m10b(spark, d):
    rows = materialize(_complete(spark, d))
    return coefficients(spark, fit_model("lasso", rows, ["rbg8"], params={"c": 0.1}))


@query("m10_logistic_l1")
def m10(spark, d):
    return _scored(spark, d, "lasso", c=1.0)


_RIDGE = """
s AS (SELECT COUNT(*) AS n, AVG(wt8) AS ma, AVG(rbg8) AS mb, AVG(2 * label - 1) AS my,
  VAR_POP(wt8) * COUNT(*) + 1 AS aa, VAR_POP(rbg8) * COUNT(*) + 1 AS bb, COVAR_POP(wt8, rbg8) * COUNT(*) AS ab,
  COVAR_POP(wt8, 2 * label - 1) * COUNT(*) AS ay, COVAR_POP(rbg8, 2 * label - 1) * COUNT(*) AS byy FROM cf{where}),
w AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS wa, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS wb FROM s)"""


@query("m11_ridge_coefficients", f"""
WITH {_COMPLETE}, {_RIDGE.format(where="")}
SELECT 'wt8' AS term, ROUND(wa, 6) AS coef FROM w UNION ALL SELECT 'rbg8', ROUND(wb, 6) FROM w
UNION ALL SELECT 'intercept', ROUND(my - wa * ma - wb * mb, 6) FROM w""")
def m11(spark, d):
    rows = materialize(_complete(spark, d))
    return coefficients(spark, fit_model("ridge", rows, ["wt8", "rbg8"]))


@query("m11_ridge_classifier", f"""
WITH {_COMPLETE}, {_RIDGE.format(where=_NOT_TEST)}, sc AS (
  SELECT subject_id, label, my + wa * (wt8 - ma) + wb * (rbg8 - mb) AS margin FROM cf, w WHERE {_SPLIT})
SELECT subject_id, label, CAST(margin > 0 AS INT) + 0.0::DOUBLE AS prediction, ROUND(margin, 6) AS probability FROM sc""")
def m11b(spark, d):
    return _scored(spark, d, "ridge", features=["wt8", "rbg8"])


@query("m12_perceptron")
def m12(spark, d):
    return _scored(spark, d, "perceptron", hidden=(100,))


@query("m13_model_comparison")
def m13(spark, d):
    """All seven models with their own settings on five folds; one repeat of the ten, as each takes 70 fits."""
    scores = compare_models(_complete(spark, d), {family: {} for family in FULL_COMPARISON}, FEATURES, k=5, repeats=1)
    return comparison_table(scores)


@query("m13_score_summary", """
SELECT sex, nursing_diet, ROUND(AVG(CASE WHEN rbg300 <= 24 THEN 1.0 ELSE 0 END), 6) AS mean_score,
  ROUND(STDDEV_POP(CASE WHEN rbg300 <= 24 THEN 1.0 ELSE 0 END), 6) AS sd_score FROM fx_onset GROUP BY 1, 2""")
def m13b(spark, d):
    rows = onset(spark, d).withColumn("score", F.when(F.col("rbg300") <= 24, 1.0).otherwise(0.0))
    return score_summary(rows, "score", ("sex", "nursing_diet"))


@query("m14_feature_sweep")
def m14(spark, d):
    """Two of the sixteen feature lists with a reduced grid."""
    options = (["sex", "wt4", "wt8", "rbg4", "rbg8"], ["sex", "nursing_diet", "wt4", "wt8", "wt12", "rbg4", "rbg8", "rbg12"])
    return feature_sweep(_features(spark, d), "tree", {"max_depth": (3, 5)}, options, k=2)


@query("m15_feature_elimination")
def m15(spark, d):
    rows = _complete(spark, d).select("subject_id", "label", *FEATURES)
    return rfe_cv(rows, FEATURES)[1]


@query("m15_size_scores")
def m15b(spark, d):
    rows = _complete(spark, d).select("subject_id", "label", *FEATURES)
    return rfe_cv(rows, FEATURES)[2]


@query("m16_importances")
def m16(spark, d):
    return importances(spark, _trained(spark, d, "forest", n_trees=20, max_depth=4)[0])


@query("m17_tree_rules")
def m17(spark, d):
    return tree_rules(spark, _trained(spark, d, "tree", max_depth=3)[0])


@query("m18_probabilities")
def m18(spark, d):
    """The tuned model's probabilities on the test rows, one forest per sex."""
    rows = materialize(_complete(spark, d))
    parts = []
    for sex in ("M", "F"):
        _, _, predicted = tuned_report(rows.filter(F.col("sex") == sex), "forest", FEATURES,
                                       LINEAGE_FOREST_GRID, metric="auc")
        parts.append(predicted.select("subject_id", "sex", "label", "prediction", "probability"))
    return parts[0].unionByName(parts[1])


# Evaluation of a fixed rule: high readings at week 8 predict onset.
_RULE = _COMPLETE + ", ru AS (SELECT *, CAST(rbg8 > 150 OR wt8 > 90 AS INT) AS pred FROM cf)"


def _ruled(spark, d):
    return _complete(spark, d).withColumn("pred", ((F.col("rbg8") > 150) | (F.col("wt8") > 90)).cast("int"))


@query("m19_classification_report", f"""
WITH {_RULE}, cl AS (SELECT c, COUNT(*) FILTER (label = c) AS support, COUNT(*) FILTER (pred = c) AS predicted,
  COUNT(*) FILTER (label = c AND pred = c) AS tp FROM ru, (SELECT UNNEST([0, 1]) AS c) GROUP BY c),
pr AS (SELECT *, COALESCE(tp / NULLIF(predicted, 0), 0) AS p, COALESCE(tp / NULLIF(support, 0), 0) AS r FROM cl),
f1 AS (SELECT *, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f FROM pr)
SELECT CAST(c AS VARCHAR) AS row, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, support FROM f1
UNION ALL SELECT 'accuracy', ROUND(SUM(tp) / SUM(support), 6), ROUND(SUM(tp) / SUM(support), 6), ROUND(SUM(tp) / SUM(support), 6),
  CAST(SUM(support) AS BIGINT) FROM f1
UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6), CAST(SUM(support) AS BIGINT) FROM f1
UNION ALL SELECT 'weighted avg', ROUND(SUM(p * support) / SUM(support), 6), ROUND(SUM(r * support) / SUM(support), 6),
  ROUND(SUM(f * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f1""")
def m19(spark, d):
    return classification_report(_ruled(spark, d), "label", "pred")


def _roc_sql(source: str, by: str = "") -> str:
    """Rates at each distinct score, without the points inside a straight stretch of counts."""
    part, keys = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    using = f"USING ({by})" if by else "ON TRUE"
    group = f"GROUP BY {by}" if by else ""
    return f"""
sc AS (SELECT {keys}score, SUM(label) AS pos, SUM(1 - label) AS neg FROM ({source}) WHERE score IS NOT NULL GROUP BY {keys}score),
tt AS (SELECT {keys}SUM(pos) AS p, SUM(neg) AS n FROM sc {group}),
ru AS (SELECT *, SUM(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, SUM(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS fp,
  ROW_NUMBER() OVER w AS rk, LEAD(pos) OVER w AS np, LEAD(neg) OVER w AS nn FROM sc WINDOW w AS ({part}ORDER BY score DESC)),
pts AS (SELECT {keys}ROUND(CAST(fp AS DOUBLE) / n, 6) AS fpr, ROUND(CAST(tp AS DOUBLE) / p, 6) AS tpr, CAST(score AS DOUBLE) AS threshold FROM ru JOIN tt {using}
  WHERE rk = 1 OR np IS NULL OR np <> pos OR nn <> neg
  UNION ALL SELECT {keys}0.0, 0.0, CAST('infinity' AS DOUBLE) FROM tt)"""


@query("m20_roc_curve", f"WITH {_COMPLETE}, {_roc_sql('SELECT rbg8 AS score, label FROM cf')} SELECT * FROM pts")
def m20(spark, d):
    return roc_curve(_complete(spark, d), "label", "rbg8")


_AUC = """au AS (SELECT {k}SUM(pos) AS p, SUM(neg) AS n, SUM(pos * (below - neg / 2)) AS w FROM (
  SELECT *, SUM(neg) OVER ({part}ORDER BY score) AS below FROM ({src})) {group})
SELECT {k}CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, ROUND(w / (CAST(p AS DOUBLE) * n), 6) AS auc FROM au"""


@query("m21_roc_auc", f"WITH {_COMPLETE}, " + _AUC.format(
    k="sex, ", part="PARTITION BY sex ", group="GROUP BY sex",
    src="SELECT sex, rbg8 AS score, SUM(label) AS pos, SUM(1 - label) AS neg FROM cf GROUP BY 1, 2"))
def m21(spark, d):
    return roc_auc(_complete(spark, d), "label", "rbg8", ("sex",))


@query("m21_roc_auc_hard", f"WITH {_RULE}, " + _AUC.format(
    k="", part="", group="", src="SELECT pred AS score, SUM(label) AS pos, SUM(1 - label) AS neg FROM ru GROUP BY 1"))
def m21b(spark, d):
    return roc_auc(_ruled(spark, d), "label", "pred")


_ALL_FEATURES = ("gestational_diet", "wt4", "wt8", "rbg4", "rbg8")
_FEATURE_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS score, label FROM cf" for f in _ALL_FEATURES)


@query("m22_feature_roc", f"WITH {_COMPLETE}, {_roc_sql(_FEATURE_LONG, 'feature')} SELECT * FROM pts")
def m22(spark, d):
    return feature_roc(_complete(spark, d), "label", _ALL_FEATURES)


@query("m22_feature_auc", f"WITH {_COMPLETE}, " + _AUC.format(
    k="feature, ", part="PARTITION BY feature ", group="GROUP BY feature",
    src=f"SELECT feature, score, SUM(label) AS pos, SUM(1 - label) AS neg FROM ({_FEATURE_LONG}) GROUP BY 1, 2"))
def m22b(spark, d):
    return feature_auc(_complete(spark, d), "label", _ALL_FEATURES)


@query("m23_cohort_counts", f"WITH {_FT} SELECT sex, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positives FROM ft GROUP BY sex")
def m23(spark, d):
    return cohort_counts(_features(spark, d), "label", ("sex",))
