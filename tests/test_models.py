import random
import threading
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.operators.evaluate import classification_report, feature_auc, roc_auc, roc_curve
from cohortline.operators.neighbours import _blocks, build_tree, knn_classify, leaves_near, nearest_neighbours
from cohortline.plans import selection
from cohortline.plans.features import SWEEP_OPTIONS
from cohortline.plans.joint import index_categories
from cohortline.plans.models import fit_model, importances, tree_rules
from cohortline.plans.selection import compare_models, comparison_table, feature_sweep, grid_search, rfe_cv


def points(spark, n, seed, dims=2, grid=None, start=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(dims)]
        if grid:
            x = [float(round(v * grid)) for v in x]
        rows.append((start + i, "M" if i % 2 else "F", *x, int(sum(x) + rng.gauss(0, 0.3) > 0)))
    return spark.createDataFrame(rows, "subject_id long, sex string, " + ", ".join(f"f{i} double" for i in range(dims)) + ", label int")


@pytest.mark.parametrize("limits", [{}, {"leaf_rows": 2, "slice_rows": 7}, {"leaf_rows": 9}])
@pytest.mark.parametrize("p", [1, 2, 3])
def test_neighbours_equal_brute_force(spark, limits, p):
    train, test = points(spark, 150, 1, grid=4), points(spark, 40, 2, grid=4, start=1000)
    got = {}
    for r in nearest_neighbours(train, test, ["f0", "f1"], "subject_id", "label", 5, p, **limits).collect():
        got.setdefault(r.subject_id, []).append((r.distance, r.neighbour))
    a = train.collect()
    for q in test.collect():
        d = sorted((float((abs(r.f0 - q.f0) ** p + abs(r.f1 - q.f1) ** p) ** (1 / p)), r.subject_id) for r in a)[:5]
        mine = sorted(got[q.subject_id])
        assert [n for _, n in mine] == [n for _, n in d]
        assert [x for x, _ in mine] == pytest.approx([x for x, _ in d])


def test_tree_bounds_the_work(spark):
    """However many points there are, a leaf is small and a query point meets about as many of them."""
    met = []
    for n in (1_000, 8_000):
        x = F.array(*[F.randn(i) for i in range(3)])
        points = spark.range(n).select(F.col("id").alias("subject_id"), F.lit(1).alias("_label"), x.alias("x"))
        tree = build_tree(points, 3, leaf_rows=20)
        sizes = {r["leaf"]: r["count"] for r in tree.points.groupBy("leaf").count().collect()}
        assert sum(sizes.values()) == n and max(sizes.values()) <= 20 and len(sizes) > n / 20
        queries = spark.range(60).select(F.col("id").alias("subject_id"), F.array(*[F.randn(i + 50) for i in range(3)]).alias("x"))
        met.append(sum(sizes[r["leaf"]] for r in leaves_near(tree, queries, 3, "subject_id", 5, 2).collect()) / 60)
    assert met[1] < 1.5 * met[0] and met[1] < 800


def test_leaves_smaller_than_k_bound_the_search(spark):
    """With leaves of fewer points than neighbours a query point still meets few of them, whole neighbours and all."""
    x = F.array(*[F.randn(i) for i in range(4)])
    points = spark.range(4_000).select(F.col("id").alias("subject_id"), F.lit(1).alias("_label"), x.alias("x"))
    queries = spark.range(40).select(F.col("id").alias("subject_id"), F.array(*[F.randn(i + 50) for i in range(4)]).alias("x"))
    tree = build_tree(points, 4, leaf_rows=4)
    wanted = {}
    for r in leaves_near(tree, queries, 4, "subject_id", 5, 2).collect():
        wanted.setdefault(r.subject_id, set()).add(r.leaf)
    assert sum(map(len, wanted.values())) / 40 < tree.nodes.where("leaf").count() / 10
    stored = tree.points.collect()
    t = np.array([r.x for r in stored])
    for q in queries.collect():
        d = np.sqrt(((t - np.array(q.x)) ** 2).sum(axis=1))
        assert {stored[i].leaf for i in np.argsort(d)[:5]} <= wanted[q.subject_id]


def test_small_leaves_share_a_call():
    """Units of one size are compared together: as many blocks as sizes, each query point with all points of its unit and no others."""
    units = pd.Series([f"{i % 3000}:0" for i in range(9_000)] + ["big:0"] * 50)
    asked = pd.Series([f"{i % 3000}:0" for i in range(6_000)] + ["big:0"] * 7 + ["none:0"])
    blocks = list(_blocks(units, asked, 4))
    assert len(blocks) == 2 and sum(len(rows) for rows, _ in blocks) == 6_007
    for rows, near in blocks:
        for row, line in zip(rows, near, strict=True):
            assert list(line) == sorted(line) and set(units[line]) == {asked[row]} and len(line) == (50 if asked[row] == "big:0" else 3)


def test_points_that_cannot_be_split(spark):
    points = spark.createDataFrame([(i, 1, [1.0, 0.0] if i < 90 else [1.0, float(i)]) for i in range(100)], "subject_id int, _label int, x array<double>")
    tree = build_tree(points, 2, leaf_rows=4)
    sizes = sorted(r["count"] for r in tree.points.groupBy("leaf").count().collect())
    assert sizes[-1] == 90 and sum(sizes) == 100 and max(sizes[:-1]) <= 4


def test_nearest_to_itself_gives_the_labels_back(spark):
    train = points(spark, 60, 3)
    for weights in ("uniform", "distance"):
        out = knn_classify(train, train, ["f0", "f1"], "subject_id", "label", 1, weights).join(train, "subject_id")
        assert out.filter("prediction != label").count() == 0
    spread = knn_classify(train, train, ["f0", "f1"], "subject_id", "label", 7, "distance").join(train, "subject_id")
    assert spread.filter("prediction != label").count() == 0  # the exact match alone decides


def test_fewer_training_rows_than_neighbours(spark):
    train, test = points(spark, 3, 4), points(spark, 2, 5, start=10)
    assert nearest_neighbours(train, test, ["f0", "f1"], "subject_id", "label", 5).count() == 6
    assert nearest_neighbours(train.limit(0), test, ["f0", "f1"], "subject_id", "label", 5).count() == 0


@pytest.mark.parametrize("tp, fn, tn, fp, auc", [(34, 12, 103, 0, 0.8695652173913043), (19, 17, 94, 4, 0.7434807256235827)])
def test_auc_of_hard_predictions(spark, tp, fn, tn, fp, auc):
    rows = [(1, 1)] * tp + [(1, 0)] * fn + [(0, 0)] * tn + [(0, 1)] * fp
    df = spark.createDataFrame(rows, "y int, s int")
    assert roc_auc(df, "y", "s").first().auc == pytest.approx(auc, abs=1e-12)
    report = {r.row: r for r in classification_report(df, "y", "s").collect()}
    assert report["accuracy"].f1 == pytest.approx((tp + tn) / len(rows))
    assert report["1"].support == tp + fn and report["1"].recall == pytest.approx(tp / (tp + fn))


def test_roc(spark):
    rng = random.Random(6)
    rows = [(int(rng.random() < 0.4), rng.randint(0, 30), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, s int, g string").withColumn("neg", -F.col("s"))
    full = sorted((r.fpr, r.tpr) for r in roc_curve(df, "y", "s", drop_intermediate=False).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(full, full[1:]))
    auc = roc_auc(df, "y", "s").first().auc
    assert full[0] == (0.0, 0.0) and full[-1] == (1.0, 1.0) and area == pytest.approx(auc)
    assert auc + roc_auc(df, "y", "neg").first().auc == pytest.approx(1.0)
    kept = sorted((r.fpr, r.tpr) for r in roc_curve(df, "y", "s").collect())
    assert set(kept) <= set(full)
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(kept, kept[1:])) == pytest.approx(auc)
    assert {r.feature: r.auc for r in feature_auc(df, "y", ["s", "neg"]).collect()}["s"] == pytest.approx(auc)
    one_class = df.filter("y = 1")
    assert roc_auc(one_class, "y", "s").first().auc is None


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, p int")
    report = {r.row: r for r in classification_report(df, "y", "p").collect()}
    assert report["1"].precision == 0.0 and report["1"].f1 == 0.0 and report["macro avg"].recall == 0.5


@pytest.mark.parametrize("family, params", [
    ("tree", {"max_depth": 4}), ("forest", {"n_trees": 10}), ("logistic", {}), ("lasso", {}), ("ridge", {}),
    ("perceptron", {"hidden": (5,)}), ("knn", {"k": 3})])
def test_every_family_learns(spark, family, params):
    train, test = points(spark, 200, 7), points(spark, 80, 8, start=1000)
    out = fit_model(family, train, ["f0", "f1"], params=params).transform(test)
    assert out.count() == 80 and {"prediction", "probability"} <= set(out.columns)
    assert out.filter("prediction = label").count() / 80 > 0.75


def test_linear_models_solve_their_equations(spark):
    train = points(spark, 150, 9)
    pdf = train.toPandas()
    x, y = pdf[["f0", "f1"]].to_numpy(), pdf.label.to_numpy()
    m = fit_model("logistic", train, ["f0", "f1"], params={"c": 0.5}).native
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(0.5 * (x.T @ (p - y)) + w).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    r = fit_model("ridge", train, ["f0", "f1"]).native
    xc, yc = x - x.mean(0), (2 * y - 1) - (2 * y - 1).mean()
    assert r.coefficients.toArray() == pytest.approx(np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), rel=1e-6)


def test_importances_and_rules_carry_names(spark):
    m = fit_model("tree", points(spark, 100, 10), ["f0", "f1"], params={"max_depth": 2})
    assert sum(r.importance for r in importances(spark, m).collect()) == pytest.approx(1.0)
    text = "\n".join(r.rule for r in tree_rules(spark, m).collect())
    assert "feature 0" not in text and ("f0" in text or "f1" in text)


def test_grid_and_sweep(spark):
    df = points(spark, 200, 11)
    model, table = grid_search(df, "tree", ["f0", "f1"], {"max_depth": (1, 4)}, k=2, metric="auc")
    rows = table.collect()
    assert len(rows) == 2 and sum(r.best for r in rows) == 1 and model.params["max_depth"] in (1, 4)
    report = feature_sweep(df, "logistic", {"c": (1.0,)}, [["f0"], ["f0", "f1"]], k=2)
    assert {r.option for r in report.collect()} == {0, 1}
    assert len(SWEEP_OPTIONS) == 16 and all(o[0] == "sex" for o in SWEEP_OPTIONS)


def test_comparison(spark):
    scores = compare_models(points(spark, 120, 12), {"tree": {}, "ridge": {}}, ["f0", "f1"], k=2, repeats=1)
    assert scores.count() == 8
    table = comparison_table(scores).collect()
    assert {r.model for r in table} == {"tree", "ridge"} and all(0.5 < r.M <= 1 for r in table)


def test_comparison_fits_side_by_side(spark, monkeypatch):
    """Fits of all models and groups run at once, and each score stays with its own fit."""
    at_once = threading.Barrier(8)

    def fit(family, train, *rest):
        at_once.wait(120)
        seen = {(r.sex, r._fold0) for r in train.select("sex", "_fold0").distinct().collect()}
        return SimpleNamespace(transform=lambda df: (family, seen))

    names = {"tree": 0.1, "ridge": 0.2}
    monkeypatch.setattr(selection, "fit_model", fit)
    monkeypatch.setattr(selection, "_score", lambda got, label, metric: names[got[0]] + min(f for _, f in got[1]) + 10 * (min(got[1])[0] == "M"))
    scores = compare_models(points(spark, 60, 14), {f: {} for f in names}, ["f0", "f1"], k=2, repeats=1).collect()
    assert len(scores) == 8
    for r in scores:
        assert r.score == pytest.approx(names[r.model] + (1 - r.fold) + 10 * (r.sex == "M"))


def test_elimination_keeps_the_feature_that_matters(spark):
    df = points(spark, 200, 13, dims=2).withColumn("noise", F.rand(1)).withColumn("label", (F.col("f0") > 0).cast("int"))
    chosen, table, sizes = rfe_cv(df, ["f0", "f1", "noise"], params={"criterion": "entropy", "max_depth": 3, "n_trees": 5}, k=2)
    assert "f0" in chosen and table.count() == 3 and sizes.count() == 3


def test_category_numbers_are_shared(spark):
    ref = spark.createDataFrame([("b",), ("a",)], "c string")
    other = spark.createDataFrame([("b",), ("zz",), (None,)], "c string")
    got = index_categories(ref, [ref, other], "c")
    assert sorted(r.c for r in got[0].collect()) == [0.0, 1.0]
    assert [r.c for r in got[1].collect()] == [1.0, None, None]
