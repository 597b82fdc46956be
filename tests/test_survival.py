import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import survival
from cohortline.operators.folds import FOLD_SEED, fold_by_subject
from cohortline.operators.mixed import mixed_folds, mixed_model, subject_likelihoods
from cohortline.catalog.statistics import with_litter_size
from cohortline.plans.joint import cross_validate_survival
from cohortline.operators.survival import (
    DIRECT_TERMS, _with_tied_sums, brier, brier_all_times, censoring_curve, concordance, cox_fits, cox_ph, integrated_brier, td_auc, td_auc_all_times)


def sample(n=120, seed=5, times=8):
    rng = random.Random(seed)
    return [(float(rng.randint(1, times)), int(rng.random() < 0.7), float(rng.randint(0, 1)), rng.gauss(0, 1)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "t double, e int, x double, z double")


def efron_loglik(rows, beta):
    ll = 0.0
    for t in sorted({r[0] for r in rows if r[1]}):
        dead = [r for r in rows if r[0] == t and r[1]]
        risk = [math.exp(beta[0] * r[2] + beta[1] * r[3]) for r in rows if r[0] >= t]
        tied = sum(math.exp(beta[0] * r[2] + beta[1] * r[3]) for r in dead)
        ll += sum(beta[0] * r[2] + beta[1] * r[3] for r in dead)
        ll -= sum(math.log(sum(risk) - i / len(dead) * tied) for i in range(len(dead)))
    return ll


def test_cox_is_at_the_maximum_of_the_efron_likelihood(spark):
    rows = sample()
    m = cox_ph(frame(spark, rows), "t", "e", ["x", "z"])
    assert m.converged and np.abs(m.score).max() < 1e-6
    best = efron_loglik(rows, m.coef)
    for step in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert efron_loglik(rows, m.coef + np.array(step)) <= best + 1e-12
    # curvature of the likelihood gives the variance
    h = 1e-4
    d2 = (efron_loglik(rows, m.coef + [h, 0]) - 2 * best + efron_loglik(rows, m.coef - [h, 0])) / h ** 2
    assert -d2 == pytest.approx(np.linalg.inv(m.variance)[0, 0], rel=1e-3)


def test_breslow_without_ties_equals_efron(spark):
    rows = [(float(i), e, x, z) for i, (_, e, x, z) in enumerate(sample(40))]
    a = cox_ph(frame(spark, rows), "t", "e", ["x"])
    b = cox_ph(frame(spark, rows), "t", "e", ["x"], ties="breslow")
    assert a.coef == pytest.approx(b.coef)
    names = a.summary().columns
    assert {"coef", "se", "hazard_ratio", "z", "p", "lower", "upper"} <= set(names)


def test_separated_data_do_not_converge(spark):
    rows = [(float(i), 1, float(i < 5), 0.0) for i in range(10)]
    m = cox_ph(frame(spark, rows), "t", "e", ["x"], max_steps=3)
    assert not m.converged


def test_many_tied_deaths(spark):
    n, d0 = 5000, 900.0
    df = spark.createDataFrame([(1000.0, d0, n)], "s0 double, d0 double, d long")
    assert n > DIRECT_TERMS
    got = _with_tied_sums(df).first()
    x = 1000.0 - np.arange(n) * d0 / n
    assert got.g == pytest.approx(np.log(x).sum(), rel=1e-10)
    assert got.a1 == pytest.approx((1 / x).sum(), rel=1e-10)
    assert got.a2 == pytest.approx((1 / x ** 2).sum(), rel=1e-10)
    last = _with_tied_sums(spark.createDataFrame([(900.0, d0, n)], "s0 double, d0 double, d long")).first()
    assert last.a1 == pytest.approx((1 / (900.0 - np.arange(n) * d0 / n)).sum(), rel=1e-10)


def test_concordance_counts_all_pairs(spark):
    rows = [(t, e, x, round(z, 1)) for t, e, x, z in sample(150)]
    con = tie = cmp = 0
    for a in rows:
        for b in rows:
            if a[1] and (b[0] > a[0] or (b[0] == a[0] and not b[1])):
                cmp += 1
                con += a[3] > b[3]
                tie += a[3] == b[3]
    got = concordance(frame(spark, rows), "t", "e", "z").first()
    assert (got.concordant, got.tied, got.comparable) == (con, tie, cmp)
    assert got.c_index == pytest.approx((con + tie / 2) / cmp)
    flat = concordance(frame(spark, rows).withColumn("k", F.lit(1.0)), "t", "e", "k").first()
    assert flat.c_index == 0.5


def test_td_auc_of_marker_and_its_negative(spark):
    df = frame(spark, sample(80)).withColumn("m", -F.col("z"))
    a = {r.t: r.auc for r in td_auc(df, "t", "e", "z", [2, 4, 6]).collect()}
    b = {r.t: r.auc for r in td_auc(df, "t", "e", "m", [2, 4, 6]).collect()}
    assert all(a[t] + b[t] == pytest.approx(1.0) for t in a)
    assert td_auc(df, "t", "e", "z", [0.5]).first().auc is None


def test_auc_at_all_times_equals_that_at_listed_ones(spark):
    df = frame(spark, sample(90)).withColumn("z", F.round("z", 0))
    got = {r.t: (r.n_cases, r.n_controls, r.auc) for r in td_auc_all_times(df, "t", "e", "z").collect()}
    want = {r.t: (r.n_cases, r.n_controls, r.auc) for r in td_auc(df, "t", "e", "z", sorted(got)).collect()}
    assert len(got) > 3 and got.keys() == want.keys()
    for t, (cases, controls, auc) in want.items():
        assert got[t][:2] == (cases, controls) and (auc is None and got[t][2] is None or got[t][2] == pytest.approx(auc))


def test_censoring_curve_reaches_zero(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 0)], "t double, e int")
    got = {r.time: (r.g, r.g_before) for r in censoring_curve(df, "t", "e").collect()}
    assert got[1.0] == (1.0, 1.0) and got[2.0] == (0.5, 1.0) and got[3.0] == (0.0, 0.5)


def test_brier_of_uncensored_data(spark):
    rows = [(t, 1, x, z) for t, _, x, z in sample(60)]
    df = frame(spark, rows)
    m = cox_ph(df, "t", "e", ["x"])
    h0 = {r.time: r.cumulative_hazard for r in m.baseline_hazard().collect()}
    base = max(v for t, v in h0.items() if t <= 3)
    want = np.mean([(math.exp(-base * math.exp(m.coef[0] * (x - m.center[0]))) - (t > 3)) ** 2 for t, _, x, _ in rows])
    scores = brier(df, m, "t", "e", [3, 5])
    assert {r.t: r.brier for r in scores.collect()}[3.0] == pytest.approx(want)
    assert 0 < integrated_brier(scores).first().ibs < 0.5


def mixed_rows(spark, sd_subject, n=60, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        u = rng.normal(0, sd_subject)
        for w in range(6):
            x = rng.normal(50, 10)
            rows.append((s, float(w), float(x), float(100 + 2 * w - 0.5 * x + u + rng.normal(0, 3))))
    return spark.createDataFrame(rows, "s int, w double, x double, y double")


def test_mixed_model_without_subject_variance_is_least_squares(spark):
    df = mixed_rows(spark, 0.0)
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.w, pdf.x])
    want = np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    m = mixed_model(df, "y", ["w", "x"], ["w"], "s", max_iter=12)
    assert m.coef == pytest.approx(want, abs=0.05)
    assert math.sqrt(m.sigma2) == pytest.approx(3, abs=0.3)


def test_mixed_model_likelihood_is_the_marginal_one(spark):
    df = mixed_rows(spark, 8.0)
    m = mixed_model(df, "y", ["w", "x"], ["w"], "s", max_iter=60, tol=1e-9)
    pdf = df.toPandas()
    ll = 0.0
    beta0 = m.coef
    for _, g in pdf.groupby("s"):
        zc = (g.w.to_numpy() - m.center[0]) / m.scale[0]
        z = np.column_stack([np.ones(len(g)), zc])
        v = z @ m.covariance @ z.T + m.sigma2 * np.eye(len(g))
        r = g.y.to_numpy() - beta0[0] - beta0[1] * g.w.to_numpy() - beta0[2] * g.x.to_numpy()
        ll -= 0.5 * (len(g) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))
    assert m.loglik == pytest.approx(ll, abs=0.05)
    assert math.sqrt(m.covariance[0, 0]) == pytest.approx(8, rel=0.3)
    own = m.transform(df, "p", with_random=True).agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    fixed = m.transform(df, "p").agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    assert own < fixed / 2
    shuffled = mixed_model(df.repartition(5), "y", ["w", "x"], ["w"], "s", max_iter=60, tol=1e-9)
    assert shuffled.coef == pytest.approx(m.coef)


def test_mixed_model_predicts_unseen_subjects(spark):
    df = mixed_rows(spark, 8.0)
    train, test = df.filter("s < 40"), df.filter("s >= 40")
    m = mixed_model(train, "y", ["w", "x"], ["w"], "s")
    got = {(r.s, r.w): r.pred for r in m.transform(test, "pred", True, test).collect()}
    for s, g in test.toPandas().groupby("s"):
        z = np.column_stack([np.ones(len(g)), (g.w.to_numpy() - m.center[0]) / m.scale[0]])
        fixed = m.coef[0] + m.coef[1] * g.w.to_numpy() + m.coef[2] * g.x.to_numpy()
        v = z @ m.covariance @ z.T + m.sigma2 * np.eye(len(g))
        want = fixed + z @ m.covariance @ z.T @ np.linalg.solve(v, g.y.to_numpy() - fixed)
        assert [got[s, w] for w in g.w] == pytest.approx(list(want), abs=1e-6)
    assert m.transform(test, "pred", True).select("pred").distinct().count() > 0


def test_litter_sizes_keep_all_subjects(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, -1), (5, -1), (6, 8)], "subject_id int, mother int")
    got = {r.subject_id: r.litter_size for r in with_litter_size(rows, rows).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}


def test_brier_at_all_times(spark):
    df = frame(spark, sample(90)).filter("t is not null")
    m = cox_ph(df, "t", "e", ["x"])
    times = sorted(r.t for r in df.select("t").distinct().collect())
    got = {r.t: r.brier for r in brier_all_times(df, m, "t", "e").collect()}
    want = {r.t: r.brier for r in brier(df, m, "t", "e", times).collect()}
    assert sorted(got) == times and all(got[t] == pytest.approx(want[t]) if want[t] is not None else got[t] is None for t in times)


def test_strata_are_fitted_and_scored_like_single_tables(spark, monkeypatch):
    monkeypatch.setattr(survival, "BLOCK", 3)
    rows = [(*r, "abc"[i % 3]) for i, r in enumerate(sample(150))]
    df = spark.createDataFrame(rows, "t double, e int, x double, z double, g string").withColumn("z", F.round("z", 1))
    fits = cox_fits(df, "t", "e", ["x"], "g")
    assert sorted(fits.models) == ["a", "b", "c"]
    scored = fits.transform(df)
    by_group = {
        "c": {r.g: r.c_index for r in concordance(scored, "t", "e", "z", ["g"]).collect()},
        "auc": {(r.g, r.t): r.auc for r in td_auc_all_times(scored, "t", "e", "z", ["g"]).collect()},
        "brier": {(r.g, r.t): r.brier for r in brier_all_times(df, fits, "t", "e").collect()},
        "ibs": {r.g: r.ibs for r in integrated_brier(brier_all_times(df, fits, "t", "e"), ["g"]).collect()}}
    for g in "ab":
        part = df.filter(F.col("g") == g)
        m = cox_ph(part, "t", "e", ["x"])
        assert fits.models[g].coef == pytest.approx(m.coef) and fits.models[g].n == m.n
        assert by_group["c"][g] == pytest.approx(concordance(part, "t", "e", "z").first().c_index)
        auc = {r.t: r.auc for r in td_auc_all_times(part, "t", "e", "z").collect()}
        assert {t: a for (k, t), a in by_group["auc"].items() if k == g} == pytest.approx(auc)
        scores = brier_all_times(part, m, "t", "e")
        assert {t: b for (k, t), b in by_group["brier"].items() if k == g} == pytest.approx({r.t: r.brier for r in scores.collect()})
        assert by_group["ibs"][g] == pytest.approx(integrated_brier(scores).first().ibs)
    assert fits.transform(df.withColumn("g", F.lit("other"))).filter("lp IS NOT NULL").count() == 0


def test_losses_alone_give_a_time_of_their_own(spark):
    df = spark.createDataFrame([(1.0, 0, 5.0), (2.0, 1, 3.0), (3.0, 0, 1.0), (4.0, 1, 2.0), (5.0, 0, 4.0)], "t double, e int, z double")
    assert [r.t for r in td_auc_all_times(df, "t", "e", "z").orderBy("t").collect()] == [2.0, 3.0, 4.0, 5.0]


def test_mixed_folds_equal_models_of_the_other_folds(spark):
    df = mixed_rows(spark, 8.0, n=45).withColumn("f", F.col("s") % 3)
    folds = mixed_folds(df, "y", ["w", "x"], ["w"], "s", "f")
    assert sorted(folds.models) == [0, 1, 2] and all(m.converged for m in folds.models.values())
    one = mixed_model(df.filter("f <> 1"), "y", ["w", "x"], ["w"], "s")
    assert folds.models[1].loglik == pytest.approx(one.loglik, abs=1e-3) and folds.models[1].coef == pytest.approx(one.coef, abs=1e-3)
    got = {(r.s, r.w): (r.pred, r.own) for r in folds.predict(df).filter("f = 1").collect()}
    left_out = df.filter("f = 1")
    want = {(r.s, r.w): r.p for r in one.transform(left_out, "p").collect()}
    own = {(r.s, r.w): r.p for r in one.transform(left_out, "p", True, left_out).collect()}
    assert got.keys() == want.keys()
    for at, (pred, mine) in got.items():
        assert pred == pytest.approx(want[at], abs=1e-2) and mine == pytest.approx(own[at], abs=0.1)


def test_a_vanishing_variance_converges(spark):
    m = mixed_model(mixed_rows(spark, 0.0, n=40, seed=11), "y", ["w", "x"], ["w"], "s")
    assert m.converged and m.iterations < 60


def test_cross_validation_scores_each_fold_under_the_models_of_the_others(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s in range(80):
        sex, diet, u = "MF"[s % 2], ("Rod", "Rab")[s % 3 == 0], rng.normal(0, 6)
        time, event = float(rng.integers(2, 9)) + 3 * (diet == "Rod"), int(rng.random() < 0.7)
        for week in range(4):
            weight = float(rng.normal(40, 5))
            rows.append((s, week * 4, weight, float(120 + week + 0.5 * weight + u + rng.normal(0, 3)), sex, diet, event, time))
    df = spark.createDataFrame(rows, "subject_id int, week int, weight double, rbg double, sex string, diet string, event int, event_time double")
    got = {r.fold: r for r in cross_validate_survival(df, k=2).collect()}
    assert sorted(got) == [1, 2] and all(r.mixed_converged and r.cox_converged for r in got.values())
    coded = fold_by_subject(df.withColumns({"sex": F.when(F.col("sex") == "M", 1.0).otherwise(0.0), "diet": F.when(F.col("diet") == "Rod", 1.0).otherwise(0.0)}),
                            "subject_id", 2, FOLD_SEED, "fold").persist()
    for fold in (0, 1):
        train, test = coded.filter(F.col("fold") != fold), coded.filter(F.col("fold") == fold)
        one = {"train": train.filter("week = 0"), "test": test.filter("week = 0")}
        cox = cox_ph(one["train"], "event_time", "event", ["sex", "diet"])
        scored = cox.transform(one["test"])
        r = got[fold + 1]
        assert r.c_index == pytest.approx(concordance(scored, "event_time", "event", "lp").first().c_index)
        assert r.integrated_brier == pytest.approx(integrated_brier(brier_all_times(one["test"], cox, "event_time", "event")).first().ibs)
        mixed = mixed_model(train, "rbg", ["weight", "week", "sex", "diet"], ["weight", "week"], "subject_id")
        error = mixed.transform(test, "p").select(F.sqrt(F.avg(F.pow(F.col("rbg") - F.col("p"), 2)))).first()[0]
        assert r.rmse == pytest.approx(error, abs=0.05) and r.own_rmse < r.rmse


def test_likelihood_of_subjects_at_the_fit(spark):
    r = np.random.default_rng(5)
    rows = []
    for s in range(60):
        a, b = r.normal(0, 4), r.normal(0, 0.6)
        rows += [(s, float(w), float(20 + a + (1.5 + b) * w + r.normal(0, 2))) for w in range(4, 40, 4)]
    df = spark.createDataFrame(rows + [(99, None, 3.0)], "id int, week double, y double")
    model = mixed_model(df, "y", ["week"], ["week"], "id")
    back = np.array([[1.0, -model.center[0] / model.scale[0]], [0.0, 1.0 / model.scale[0]]])  # effects of the column as it is

    def total(coef, sigma2):
        found = subject_likelihoods(df, "y", ["week"], ["week"], "id", coef, back @ model.covariance @ back.T, sigma2).toPandas()
        assert len(found) == 60 and (found["n"] == 9).all()
        return found["loglik"].sum()

    best = total(model.coef, model.sigma2)
    assert abs(best - model.loglik) < 1e-6 * abs(best)
    for moved in ([0.3, 0.0], [-0.3, 0.0], [0.0, 0.05], [0.0, -0.05]):
        assert total(model.coef + np.array(moved), model.sigma2) < best
    assert max(total(model.coef, model.sigma2 * 1.1), total(model.coef, model.sigma2 / 1.1)) < best
