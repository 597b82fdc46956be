"""The analyses end to end over the panel of the given tables."""

import pytest
from pyspark.sql import functions as F

from cohortline.catalog.views import panel
from cohortline.plans import reports
from cohortline.session import materialize


@pytest.fixture(scope="module")
def study(spark):
    m, o = panel(spark, "/root/testdata/sf0.01")
    # onset of 300 leaves subjects without onset, as onset of 200 does not
    return m, materialize(o.withColumn("rbg200", F.col("rbg300")))


def test_load_study(spark):
    subjects = spark.createDataFrame([("a", "1/5/21 00:00:00", None), ("b", "1/5/21 00:00:00", "2/5/21 00:00:00")],
                                     "NR_Name string, birth_date string, death_date string")
    rows = spark.createDataFrame([("a", 4, "250.4", "30"), ("a", 6, "900", "30"), ("b", 4, "n/a", "31.5")],
                                 "NR_Name string, week int, rbg string, weight string")
    readings, onset = reports.load_study(subjects, rows)
    assert sorted((r.NR_Name, r.rbg, r.weight) for r in readings.collect()) == [("a", 250.0, 30.0), ("b", None, 32.0)]
    assert {r.NR_Name: (r.rbg200, r.rbg300) for r in onset.collect()} == {"a": (4, 80), "b": (80, 80)}


def test_distributions(study):
    hist, density, box = reports.readings_by_diet(*study, grid=20)
    sums = hist.groupBy("diet").agg(F.sum(F.col("density") * 10).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums) and density.count() == 20 * len(sums) and box.count() == len(sums)


def test_incidence_and_hazards(study):
    out = reports.incidence_report(study[1])
    assert out["bands"].filter("lower > percent_free OR upper < percent_free").count() == 0
    assert out["incidence"].agg(F.max("percent")).first()[0] == 100.0
    models = reports.diet_hazards(study[1])
    assert set(models) == {"M", "F"} and all(m.converged for m in models.values())


def test_group_reports(study):
    out = reports.weight_report(*study)
    assert out["overlap"].count() == 0 and out["counts"].count() == 4
    assert out["welch"].filter("t IS NOT NULL").count() > 0 and out["box"].count() > 0
    grown = reports.growth_report(*study)
    assert grown["welch"].count() == 2 and grown["box"].count() == 4


def test_correlations(study):
    rows = reports.correlation_report(*study)
    assert rows.filter("x = y AND r IS NOT NULL AND abs(r - 1) > 1e-9").count() == 0
    assert rows.count() == 2 * 9 * 9


def test_tree_and_forest_reports(study):
    out = reports.tree_report(*study, grid={"max_depth": (2, 3)}, k=2)
    assert {"rules", "report", "roc", "auc", "feature_roc", "importances"} <= set(out)
    assert out["auc"].first().auc >= 0.5
    forests = reports.risk_report(*study, cutoffs={"M": 12, "F": 16}, features=("nursing_diet", "wt4", "wt8"),
                                  grid={"max_depth": (3,), "n_trees": (5,)}, k=2)
    assert set(forests) == {"M", "F"} and forests["M"]["predictions"].count() > 0


def test_sweep_and_comparison(study):
    options = [["sex", "wt4", "wt8"], ["sex", "nursing_diet", "rbg4", "rbg8"]]
    rows = reports.sweep_report(*study, "sweep_logistic", {"c": (0.1, 1.0)}, options, k=2, percentile=None)
    assert {r.option for r in rows.collect()} == {0, 1}
    scores = reports.model_comparison(*study, {"tree": {}}, folds=2, repeats=1)
    assert scores.count() == 4


def test_elimination(study):
    out = reports.elimination_report(*study, cutoffs={"M": 12, "F": 16}, features=("wt4", "wt8"), k=2)
    assert all(t.filter("selected").count() >= 1 for t in out.values())
