import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions.tails import p_value
from cohortline.operators import running, stats
from cohortline.operators.folds import fold_by_subject, split, stratified_folds


def test_tail_probabilities(spark):
    # known values of the t, normal and chi-square tables
    df = spark.createDataFrame([(2.228139, 10.0), (0.0, 3.0), (12.7062, 1.0), (1.959964, 1e6)], "t double, df double")
    got = [r.p for r in df.select(p_value("t", "t", "df").alias("p")).collect()]
    assert got == pytest.approx([0.05, 1.0, 0.05, 0.05], abs=1e-5)
    chi = spark.createDataFrame([(3.841459, 1.0), (5.991465, 2.0), (7.814728, 3.0), (18.307038, 10.0)], "x double, k double")
    assert [r.p for r in chi.select(p_value("x", "chi2", "k").alias("p")).collect()] == pytest.approx([0.05] * 4, abs=1e-6)
    z = spark.createDataFrame([(1.959964,), (None,)], "z double")
    got = [r.p for r in z.select(p_value("z").alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None


def test_running_totals_over_cut_axes_equal_one_window(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randint(0, 9)) for g in "abc" for v in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame([*rows, (None, 5.0, 3)], "g string, v double, n int")
    for descending in (False, True):
        table = running.cut_axis(df, "v", range_rows=75)
        assert table.select("_range").distinct().count() == 17
        a = running.running_totals(table, "v", {"s": "n"}, ["g"], descending, range_col="_range")
        b = running.running_totals(df, "v", {"s": "n"}, ["g"], descending, bounded=True)
        assert sorted(map(repr, a.select("g", "v", "s").collect())) == sorted(map(repr, b.select("g", "v", "s").collect()))
    by_value = df.drop("g").groupBy("v").agg(F.sum("n").alias("n"))
    monkeypatch.setattr(running, "RANGE_ROWS", 100)
    both = running.running_totals(by_value, "v", {"s": "n"}, rest={"r": "n"})
    total = both.agg(F.max("s"), F.max("r"), F.min(F.col("s") + F.col("r") - F.col("n")), F.max(F.col("s") + F.col("r") - F.col("n"))).first()
    assert set(total) == {sum(n for _, _, n in rows) + 3}
    cut = running.cut_axis(by_value, "v", range_rows=50)
    before = {r.v: (r._previous_v, r._previous_n) for r in running.previous(cut, "v", ["v", "n"]).collect()}
    ordered = sorted((r.v, r.n) for r in by_value.collect())
    assert before == {v: (ordered[i - 1] if i else (None, None)) for i, (v, _) in enumerate(ordered)}


def test_quantiles_of_cut_axes(spark):
    values = [random.Random(2).gauss(0, 1) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = np.quantile(values, [0.25, 0.5, 0.75])
    got = stats.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(want))


def test_welch_needs_two_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    got = stats.welch_ttest(df, "v", "g", ("a", "b")).first()
    assert got.t is None and got.p is None and got.n1 == 2
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert stats.welch_ttest(same, "v", "g", ("a", "b")).first().t is None


def test_growth_divides_by_the_later_week(spark):
    df = spark.createDataFrame([("a", 4, 50.0), ("a", 8, 100.0), ("b", 4, 1.0), ("c", 4, 0.0), ("c", 8, 0.0)],
                               "subject_id string, week int, weight double")
    got = {r.subject_id: r.percent_increase for r in stats.growth(df).collect()}
    assert got == {"a": 50.0, "c": 0.0}
    assert {r.subject_id: r.percent_increase for r in stats.growth(df, base=4).collect()}["a"] == 100.0


def test_correlation_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0)], "a double, b double, c double")
    got = {(r.x, r.y): r.r for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] is None and got[("c", "c")] is None and len(got) == 9


def test_box_and_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    got = stats.box_summary(df, "v").first()
    assert (got.q1, got.median, got.q3) == (2.25, 3.5, 4.75)
    assert (got.whisker_low, got.whisker_high, got.n_outliers) == (1.0, 5.0, 1)
    assert [r.v for r in stats.outliers(df, "v").collect()] == [100.0]
    assert stats.approx_box(df, "v").first().max == 100.0


def test_histogram_closes_the_last_edge(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 9.0), ("a", 10.0), ("b", 20.0)], "g string, v double")
    got = {(r.g, r.bin): (r["count"], r.density) for r in stats.histogram(df, "v", ["g"], 10).collect()}
    assert got == {("a", 0): (2, pytest.approx(2 / 30)), ("a", 1): (1, pytest.approx(1 / 30)), ("b", 1): (1, 0.1)}


def test_density_integrates_to_about_one(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(400)], "v double")
    pts = sorted((r.x, r.density) for r in stats.kde(df, "v", grid=100).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert 0.95 < area < 1.01
    sd = np.std([r.v for r in df.collect()], ddof=1) * 400 ** -0.2
    x = pts[50][0]
    want = np.mean([math.exp(-0.5 * ((x - r.v) / sd) ** 2) for r in df.collect()]) / sd / math.sqrt(2 * math.pi)
    assert pts[50][1] == pytest.approx(want)


def test_splits_and_folds(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("y", (F.col("k") % 3 == 0).cast("int"))
    train, test = split(df, "k")
    assert train.count() + test.count() == 1000 and train.join(test, "k").count() == 0 and 150 < test.count() < 250
    again = {r.k for r in split(df.repartition(7), "k")[1].collect()}
    assert again == {r.k for r in test.collect()}
    folds = stratified_folds(df, "k", "y", 5)
    sizes = {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert folds.count() == 1000 and all(abs(sizes[(1, f)] - 334 / 5) < 1 for f in range(5))
    twice = df.select("k").union(df.select("k"))
    assert fold_by_subject(twice, "k").distinct().count() == 1000


def test_kernel_density_of_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 2.0), ("c", 2.0)], "g string, v double")
    got = stats.kde(df, "v", ("g",), grid=5).collect()
    assert len(got) == 15 and all((r.density is None) == (r.g != "a") for r in got)


def test_tails_of_few_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1.0, 1.05, 0.493606), (1.0, 1.2, 0.476804), (1.0, 1.0, 0.5), (0.0, 1.5, 1.0)], "t double, k double, p double")
    assert all(r.got == pytest.approx(r.p, abs=1e-6) for r in df.select("p", p_value("t", "t", "k").alias("got")).collect())
    chi = spark.createDataFrame([(2.7, 2.7)], "x double, k double").select(p_value("x", "chi2", "k").alias("p")).first().p
    v = np.linspace(0, math.sqrt(2.7), 20_001)  # with x = v * v the density has no singularity
    f = 2 * v ** 1.7 * np.exp(-v * v / 2) / (2 ** 1.35 * math.gamma(1.35))
    assert chi == pytest.approx(1 - np.trapezoid(f, v), abs=1e-7)


def test_correlations_of_many_columns(spark):
    r = np.random.default_rng(3)
    x = r.normal(1000, 1, (120, 40)) + r.normal(0, 1, (120, 1))
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    names = [f"c{i}" for i in range(40)]
    rows = [("ab"[i % 2], *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in names))
    got = {(q.g, q.x, q.y): q.r for q in stats.corr_matrix(df, names, ("g",)).collect()}
    assert len(got) == 2 * 40 * 40
    for g in range(2):
        part = x[g::2]
        for i, j in ((0, 1), (3, 3), (12, 30), (39, 2)):
            known = ~np.isnan(part[:, i]) & ~np.isnan(part[:, j])
            assert got["ab"[g], f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(part[known, i], part[known, j])[0, 1], abs=1e-9)
        assert got["ab"[g], "c7", "c1"] is None
    assert stats.corr_matrix(df.limit(0), names[:2]).filter("r IS NOT NULL").count() == 0


def test_density_rows_do_not_depend_on_the_grid(spark):
    values = [("a", float(v)) for v in np.random.default_rng(4).normal(0, 2, 300).round(2)] + [("b", 1.0), ("b", 1.0), (None, 0.5), (None, 2.5)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {(q.g, q.point): (q.x, q.density) for q in stats.kde(df, "v", ("g",), grid=31).collect()}
    v = np.array([x for g, x in values if g == "a"])
    h = v.std(ddof=1) * len(v) ** -0.2
    low, high = min(x for _, x in values), max(x for _, x in values)
    for i in (0, 10, 30):
        at = low + (high - low) * i / 30
        want = np.exp(-0.5 * ((at - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert got["a", i] == pytest.approx((at, want))
    assert got["b", 3][1] is None and got[None, 3][1] > 0 and len(got) == 3 * 31
    assert stats.kde(df.limit(0), "v", ("g",), grid=5).count() == 0
