"""Proportional hazards, concordance, time-dependent AUC and Brier scores.

Every fit step is one aggregation of the data; the driver sees only matrices of the size of the
covariate list, never rows or event times. The models of all strata (sexes, folds) are fitted side by side: a step of all of
them is one job, whose plan does not depend on the coefficients. Scores take the strata as ``by``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.tails import p_value
from cohortline.operators.running import cut_axis, previous, running_totals
from cohortline.session import materialize

DIRECT_TERMS = 256  # tied-death terms summed one by one; the smooth rest in closed form
BLOCK = 1024        # times, and counted rows, of one piece of a Brier score


@dataclass
class CoxModel:
    """A fitted proportional-hazards model."""

    covariates: list[str]
    coef: np.ndarray
    variance: np.ndarray
    center: np.ndarray
    loglik: float
    loglik_null: float
    score: np.ndarray
    iterations: int
    converged: bool
    n: int
    n_events: int
    ties: str
    _cells: DataFrame = field(repr=False)

    def linear_predictor(self) -> Column:
        """Sum of coefficient times centered covariate."""
        lp = F.lit(0.0)
        for c, b, m in zip(self.covariates, self.coef, self.center):
            lp = lp + (F.col(c).cast("double") - F.lit(float(m))) * F.lit(float(b))
        return lp

    def transform(self, df: DataFrame, lp: str = "lp", hazard: str = "partial_hazard") -> DataFrame:
        """Add the linear predictor and the relative hazard."""
        return df.withColumn(lp, self.linear_predictor()).withColumn(hazard, F.exp(F.col(lp)))

    def summary(self) -> DataFrame:
        return cox_summary(self)

    def baseline_hazard(self) -> DataFrame:
        """Cumulative baseline hazard (Breslow) at each time, for centered covariates."""
        return _baseline(self._cells, self.linear_predictor(), [])


@dataclass
class CoxStrata:
    """Models of the same covariates, one for each value of the column ``by``."""

    by: str
    models: dict[object, CoxModel]
    _cells: DataFrame = field(repr=False)

    def _with_coefficients(self, df: DataFrame) -> DataFrame:
        return _with_points(df, self.by, {s: (m.coef, m.center) for s, m in self.models.items()})

    def _covariates(self) -> list[str]:
        return next(iter(self.models.values())).covariates if self.models else []

    def transform(self, df: DataFrame, lp: str = "lp", hazard: str = "partial_hazard") -> DataFrame:
        """Add linear predictor and relative hazard under the model of each row's stratum; other strata have null."""
        return self._with_coefficients(df).select(*df.columns, _predictor(self._covariates()).alias(lp)).withColumn(hazard, F.exp(F.col(lp)))

    def summary(self) -> DataFrame:
        rows = [(s, *r) for s, m in self.models.items() for r in _estimates(m)]
        kind = self._cells.schema[self.by].dataType.simpleString()
        return _tested(self._cells.sparkSession.createDataFrame(rows, f"`{self.by}` {kind}, covariate string, coef double, se double"))

    def baseline_hazard(self) -> DataFrame:
        """The hazards of :meth:`CoxModel.baseline_hazard` by stratum."""
        return _baseline(self._with_coefficients(self._cells), _predictor(self._covariates()), [self.by])


def _predictor(covs: Sequence[str]) -> Column:
    """The linear predictor under coefficients ``_b`` and centers ``_m``."""
    lp = F.get("_b", F.lit(0)) * 0
    for i, c in enumerate(covs):
        lp = lp + (F.col(c).cast("double") - F.get("_m", F.lit(i))) * F.get("_b", F.lit(i))
    return lp


def _with_points(df: DataFrame, by: str, values: dict[object, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add the coefficients ``_b`` and centers ``_m`` of each row's stratum; null for strata that are not listed.

    They are constants of map type, which compiled code takes by reference: every step of a fit runs the same code.
    """
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    if not values:
        return df.withColumns({"_b": F.lit(None).cast("array<double>"), "_m": F.lit(None).cast("array<double>")})
    table = lambda i: F.create_map(*[x for s, pair in values.items() for x in (F.lit(s), numbers(pair[i]))])
    return df.withColumns({"_b": F.try_element_at(table(0), F.col(by)), "_m": F.try_element_at(table(1), F.col(by))})


def _baseline(cells: DataFrame, predictor: Column, by: list[str]) -> DataFrame:
    per = cells.groupBy(*by, "_range", "_time").agg(
        F.sum(F.exp(predictor) * F.col("_n")).alias("_r"), F.sum(F.col("_event") * F.col("_n")).alias("_d"))
    at_risk = running_totals(per, "_time", {"_at_risk": "_r"}, by, descending=True, range_col="_range")
    steps = materialize(at_risk.select(*by, "_range", F.col("_time").alias("time"), (F.col("_d") / F.col("_at_risk")).alias("hazard")))
    return running_totals(steps, "time", {"cumulative_hazard": "hazard"}, by, range_col="_range").select(
        *by, "time", "hazard", "cumulative_hazard")


def _with_tied_sums(per_time: DataFrame) -> DataFrame:
    """Add sums over l = 0..d-1 of log x, 1/x and 1/x^2 at x = s0 - l b with b = d0 / d: g, a1, a2.

    The last DIRECT_TERMS terms, nearest to zero, are added one by one. The terms before them are
    smooth enough for the Euler-Maclaurin formula, so a time shared by any number of deaths costs
    the same.
    """
    cut = per_time.selectExpr(
        "*", "d0 / d AS b", f"CAST(greatest(d - {DIRECT_TERMS}, 0) AS BIGINT) AS m").withColumn("e", F.expr("s0 - m * b"))
    terms = "transform(sequence(m, CAST(d AS BIGINT) - 1), l -> s0 - l * b)"
    head = {  # integral - (f(m) - f(0)) / 2 + (f'(m) - f'(0)) / 12
        "g": "(s0 * ln(s0) - s0 - e * ln(e) + e) / b - (ln(e) - ln(s0)) / 2 + (b / s0 - b / e) / 12",
        "a1": "(ln(s0) - ln(e)) / b - (1 / e - 1 / s0) / 2 + (b / (e * e) - b / (s0 * s0)) / 12",
        "a2": "(1 / e - 1 / s0) / b - (1 / (e * e) - 1 / (s0 * s0)) / 2 + (b / (e * e * e) - b / (s0 * s0 * s0)) / 6"}
    tail = {"g": "ln(x)", "a1": "1 / x", "a2": "1 / (x * x)"}
    return cut.withColumn("_x", F.expr(terms)).withColumns({
        k: F.expr(f"aggregate(_x, 0D, (s, x) -> s + {tail[k]}) + IF(m > 0, {head[k]}, 0D)") for k in head}).drop("_x")


def _cox_step(cells: DataFrame, covs: Sequence[str], by: str, at: dict[object, tuple[np.ndarray, np.ndarray]], ties: str):
    """``{stratum: (log-likelihood, score, information)}`` at the coefficients and centers ``at``: one aggregation by event time."""
    p = len(covs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    x = [f"(`{c}` - _m[{i}])" for i, c in enumerate(covs)]
    eta = " + ".join(f"{xi} * _b[{i}]" for i, xi in enumerate(x))
    terms = {"0": "1"} | {f"1_{i}": x[i] for i in range(p)} | {f"2_{i}_{j}": f"{x[i]} * {x[j]}" for i, j in pairs}
    here = _with_points(cells.withColumnRenamed(by, "_stratum"), "_stratum", at).filter("_b IS NOT NULL")  # models that are still searching
    by = "_stratum"  # the names of sums are free of a caller's
    weighed = here.selectExpr("*", f"{eta} AS _eta", f"exp({eta}) * _n AS _risk", "_event * _n AS _dead")
    aggs = ["sum(_dead) AS d", "sum(_eta * _dead) AS eta_d", *[f"sum({x[i]} * _dead) AS x_{i}" for i in range(p)]]
    for k, term in terms.items():  # r: all at this time, d: those with the event
        aggs += [f"sum(_risk * {term}) AS r{k}", f"sum(_risk * _event * {term}) AS d{k}"]
    per = weighed.groupBy(by, "_range", "_time").agg(*map(F.expr, aggs))
    run = running_totals(per, "_time", {f"s{k}": f"r{k}" for k in terms}, [by], descending=True, range_col="_range").filter("d > 0")
    # With weights f = l/d and x_l = s0 - f d0 both sums split into terms of 1/x_l and 1/x_l^2:
    # (s1 - f d1) / x_l = e + c / x_l, where e = d1/d0 and c = s1 - d1 s0/d0 (Breslow: e = 0, c = s1).
    if ties == "efron":
        run = _with_tied_sums(run)
        e = {k: f"(d{k} / d0)" for k in terms}
        c = {k: f"(s{k} - d{k} * s0 / d0)" for k in terms}
    else:
        run = run.selectExpr("*", "d * ln(s0) AS g", "d / s0 AS a1", "d / (s0 * s0) AS a2")
        e, c = {k: "0D" for k in terms}, {k: f"s{k}" for k in terms}
    out = ["sum(eta_d - g) AS ll"]
    for i in range(p):
        out.append(f"sum(x_{i} - ({e[f'1_{i}']} * d + {c[f'1_{i}']} * a1)) AS u_{i}")
    for i, j in pairs:
        ei, ej, ci, cj = e[f"1_{i}"], e[f"1_{j}"], c[f"1_{i}"], c[f"1_{j}"]
        second = f"({e[f'2_{i}_{j}']} * d + {c[f'2_{i}_{j}']} * a1)"
        square = f"({ei} * {ej} * d + ({ei} * {cj} + {ej} * {ci}) * a1 + {ci} * {cj} * a2)"
        out.append(f"sum({second} - {square}) AS i_{i}_{j}")
    found = {s: (0.0, np.zeros(p), np.zeros((p, p))) for s in at}
    for row in run.groupBy(by).agg(*map(F.expr, out)).collect():  # a row for each model
        info = np.zeros((p, p))
        for i, j in pairs:
            info[i, j] = info[j, i] = row[f"i_{i}_{j}"] or 0.0
        found[row[by]] = row["ll"] or 0.0, np.array([row[f"u_{i}"] or 0.0 for i in range(p)]), info
    return found


class _Search:
    """Newton's method for one stratum, a point at a time."""

    def __init__(self, p: int, start: tuple):
        self.beta = np.zeros(p)
        self.ll, self.u, self.info = start
        self.null, self.steps, self.converged = self.ll, 0, False
        self.active = self._propose()

    def _propose(self) -> bool:
        self.factor, self.tries = 1.0, 0
        try:
            self.step = np.linalg.solve(self.info, self.u)
        except np.linalg.LinAlgError:
            return False
        return True

    def trial(self) -> np.ndarray:
        return self.beta + self.factor * self.step

    def take(self, result: tuple, tol: float, max_steps: int) -> None:
        """Move to the trial point, or halve the step if the likelihood fell."""
        worse = not (math.isfinite(result[0]) and result[0] >= self.ll - 1e-9 * abs(self.ll))
        if worse and self.tries < 19:
            self.factor, self.tries = self.factor / 2, self.tries + 1
            return
        self.beta, moved = self.trial(), np.max(np.abs(self.factor * self.step), initial=0.0)
        self.ll, self.u, self.info = result
        self.steps += 1
        self.converged = bool(moved < tol)
        self.active = not self.converged and self.steps < max_steps and self._propose()


def cox_fits(df: DataFrame, duration: str, event: str, covariates: Sequence[str], by: str, ties: str = "efron",
             max_steps: int = 25, tol: float = 1e-9) -> CoxStrata:
    """Cox regressions by Newton's method, one for each value of ``by``, in as many jobs as the slowest of them takes.

    Rows are first reduced to counts of equal (stratum, time, event, covariates), which for coded covariates
    on a week grid is a tiny table; it is written once, with the axis of times cut into ranges. Rows with a null are left out.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be 'efron' or 'breslow'")
    covs, p = list(covariates), len(covariates)
    rows = df.select(by, F.col(duration).cast("double").alias("_time"), F.col(event).cast("int").alias("_event"),
                     *[F.col(c).cast("double").alias(c) for c in covs]).dropna()
    cells = cut_axis(rows.groupBy(by, "_time", "_event", *covs).agg(F.count(F.lit(1)).cast("double").alias("_n")), "_time")
    stats = cells.groupBy(by).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_event")).alias("d"),
                                  *[(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"m{i}") for i, c in enumerate(covs)]).collect()
    sizes = {r[by]: (int(r["n"]), int(r["d"])) for r in stats}
    center = {r[by]: np.array([r[f"m{i}"] for i in range(p)]) for r in stats}
    first = _cox_step(cells, covs, by, {s: (np.zeros(p), m) for s, m in center.items()}, ties) if sizes else {}
    searches = {s: _Search(p, first[s]) for s in sizes}
    while active := {s: x for s, x in searches.items() if x.active}:
        results = _cox_step(cells, covs, by, {s: (x.trial(), center[s]) for s, x in active.items()}, ties)
        for s, x in active.items():
            x.take(results[s], tol, max_steps)
    models = {}
    for s, x in searches.items():
        try:
            variance = np.linalg.inv(x.info)
        except np.linalg.LinAlgError:
            variance = np.full((p, p), np.nan)
        models[s] = CoxModel(covs, x.beta, variance, center[s], x.ll, x.null, x.u, x.steps, x.converged, *sizes[s], ties,
                             cells.filter(F.col(by) == F.lit(s)))
    return CoxStrata(by, models, cells)


def cox_ph(df: DataFrame, duration: str, event: str, covariates: Sequence[str], ties: str = "efron",
           max_steps: int = 25, tol: float = 1e-9) -> CoxModel:
    """The Cox regression of all rows: :func:`cox_fits` with a single stratum."""
    fits = cox_fits(df.withColumn("_stratum", F.lit(0)), duration, event, covariates, "_stratum", ties, max_steps, tol)
    if fits.models:
        return fits.models[0]
    p = len(covariates)
    return CoxModel(list(covariates), np.zeros(p), np.full((p, p), np.nan), np.zeros(p), 0.0, 0.0, np.zeros(p), 0, False, 0, 0, ties, fits._cells)


def _estimates(model: CoxModel) -> list[tuple[str, float, float]]:
    se = np.sqrt(np.diag(model.variance))
    return [(c, float(b), float(s)) for c, b, s in zip(model.covariates, model.coef, se)]


def _tested(t: DataFrame, z95: float = 1.959963984540054) -> DataFrame:
    t = t.coalesce(1).withColumn("hazard_ratio", F.exp("coef")).withColumn("z", F.col("coef") / F.col("se"))
    t = t.withColumns({"lower": F.exp(F.col("coef") - z95 * F.col("se")),
                       "upper": F.exp(F.col("coef") + z95 * F.col("se"))})
    return t.withColumn("p", p_value("z", "normal"))


def cox_summary(model: CoxModel) -> DataFrame:
    """Coefficient, hazard ratio, standard error, z, p and 95 % limits, one row per covariate."""
    return _tested(model._cells.sparkSession.createDataFrame(_estimates(model), "covariate string, coef double, se double"))


def _times(df: DataFrame, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and deaths at each time."""
    return df.groupBy(*by, F.col(duration).alias("time")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(event).cast("long")).alias("deaths"))


def risk_sets(df: DataFrame, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Number at risk, deaths and losses at each time."""
    run = running_totals(_times(df, duration, event, by), "time", {"at_risk": "_n"}, by, descending=True)
    return run.select(*by, "time", "at_risk", "deaths", (F.col("_n") - F.col("deaths")).alias("lost"))


def censoring_curve(df: DataFrame, time: str, event: str) -> DataFrame:
    """Kaplan-Meier estimate of staying uncensored, at and just before each time.

    Deaths come before losses at equal times. Products are sums of logarithms; a factor of zero is
    counted apart, as its logarithm is undefined.
    """
    return _curve(cut_axis(_times(df, time, event), "time")).drop("_range").withColumnsRenamed({"_g": "g", "_g_before": "g_before"})


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, on, how).drop(*[f"_r_{c}" for c in keys])


def _counted(df: DataFrame, time: str, event: str, value: Column, name: str, by: Sequence[str]) -> DataFrame:
    """Counts ``_n`` of equal (``by``, time, ``_e``, ``name``), written once, with the axis of times cut into ranges."""
    rows = df.select(*by, F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("_e"), value.cast("double").alias(name))
    return cut_axis(rows.dropna(subset=["time", "_e", name]).groupBy(*by, "time", "_e", name).agg(F.count(F.lit(1)).alias("_n")), "time")


def _cell_curve(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The censoring curve of counted cells (time, _e, ..., _n) that are cut into ranges; its rows keep their range."""
    return _curve(cells.groupBy(*by, "_range", "time").agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_e")).alias("deaths")), by)


def _curve(times: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sets = running_totals(times, "time", {"at_risk": "_n"}, by, descending=True, range_col="_range")
    lost, exposed = F.col("_n") - F.col("deaths"), F.col("at_risk") - F.col("deaths")
    factor = F.when(exposed > 0, 1 - lost / exposed).otherwise(1.0)
    steps = materialize(sets.withColumns({"_f": factor, "lost": lost})
                        .withColumns({"_ln": F.when(F.col("_f") > 0, F.log("_f")).otherwise(0.0),
                                      "_zero": F.when(F.col("_f") <= 0, 1).otherwise(0)}))
    run = running_totals(steps, "time", {"_s": "_ln", "_z": "_zero"}, by, range_col="_range")
    g = F.when(F.col("_z") > 0, 0.0).otherwise(F.exp("_s"))
    g_before = F.when(F.col("_z") - F.col("_zero") > 0, 0.0).otherwise(F.exp(F.col("_s") - F.col("_ln")))
    return run.select(*by, "_range", "time", "at_risk", "deaths", "lost", g.alias("_g"), g_before.alias("_g_before"))


def event_times(df: DataFrame, time: str) -> DataFrame:
    """Sorted distinct times."""
    return df.select(time).distinct().orderBy(time)


def td_auc(df: DataFrame, time: str, event: str, marker: str, times: Sequence[float]) -> DataFrame:
    """Cumulative/dynamic AUC of a marker at each of ``times``, weighted for censoring.

    Cases have had the event by t, weighted by the chance of being uncensored until then; controls
    are later than t. Pairs are counted from running totals over the marker, never listed.
    """
    cells = _counted(df, time, event, F.col(marker), "_m", ())
    curve = _cell_curve(cells).select("time", "_g_before")
    rows = cells.join(curve, "time").withColumn(
        "t", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    case = (F.col("_e") == 1) & (F.col("time") <= F.col("t"))
    sums = rows.groupBy("t", "_m").agg(
        F.sum(F.when(case, F.col("_n") / F.col("_g_before")).otherwise(0.0)).alias("_case"),
        F.sum(F.when(case, F.col("_n")).otherwise(0)).alias("_n_case"),
        F.sum(F.when(F.col("time") > F.col("t"), F.col("_n")).otherwise(0)).alias("_control"))
    run = running_totals(sums, "_m", {"_upto": "_control"}, ("t",))
    wins = F.col("_case") * (F.col("_upto") - F.col("_control") / 2)
    out = run.groupBy("t").agg(F.sum(wins).alias("_w"), F.sum("_case").alias("_c"), F.sum("_n_case").alias("n_cases"),
                               F.sum("_control").alias("n_controls"))
    return out.select("t", "n_cases", "n_controls", F.try_divide("_w", F.col("_c") * F.col("n_controls")).alias("auc"))


def td_auc_all_times(df: DataFrame, time: str, event: str, marker: str, by: Sequence[str] = ()) -> DataFrame:
    """The AUC of :func:`td_auc` at every distinct time from the first event on, without a row for each row and time.

    From one time to the next the pairs of the new cases with later rows come in, and those of earlier cases with the
    rows that leave go out. Both are sums over pairs by marker, counted like those of :func:`concordance`: one row
    for each binary digit of the marker's rank, with running totals over time. Times at which rows are only lost count too.
    """
    by = list(by)
    cells = _counted(df, time, event, F.col(marker), "_m", by)
    curve = _cell_curve(cells, by).select(*by, "time", "_g_before")
    weighed = materialize(_matched(cells, curve, [*by, "time"]).withColumn(
        "_w", F.when(F.col("_e") == 1, F.col("_n") / F.col("_g_before")).otherwise(0.0)))
    rows = _by_digits(weighed, "_m", by).filter("_digit <> -1")
    tied = F.col("_digit") == -2
    low, high = tied | (F.col("_bit") == 0), tied | (F.col("_bit") == 1)
    per = materialize(rows.groupBy(*by, "_range", "_digit", "_prefix", "time").agg(
        F.sum(F.when(low, F.col("_n")).otherwise(0)).alias("_low"), F.sum(F.when(high, F.col("_w")).otherwise(0.0)).alias("_case")))
    run = running_totals(per, "time", {"_upto": "_case"}, [*by, "_digit", "_prefix"], range_col="_range", rest={"_from": "_low"})
    came = F.col("_case") * (F.col("_from") - F.col("_low"))
    went = F.col("_low") * (F.col("_upto") - F.col("_case"))
    change = run.groupBy(*by, "time").agg(F.sum((came - went) * F.when(tied, 0.5).otherwise(1.0)).alias("_change"))
    per_time = weighed.groupBy(*by, "_range", "time").agg(
        F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.sum(F.when(F.col("_e") == 1, F.col("_n")).otherwise(0)).alias("_d"))
    steps = running_totals(materialize(_matched(per_time, change, [*by, "time"])), "time", {"_won": "_change", "_c": "_w", "n_cases": "_d"},
                           by, range_col="_range", rest={"_left": "_n"})
    controls = F.col("_left") - F.col("_n")
    return steps.filter("n_cases > 0").select(*by, F.col("time").alias("t"), "n_cases", controls.alias("n_controls"),
                                              F.try_divide("_won", F.col("_c") * controls).alias("auc"))


def brier(df: DataFrame, model: CoxModel, time: str, event: str, times: Sequence[float]) -> DataFrame:
    """Brier score of the model's survival at each time, weighted for censoring."""
    cells = _counted(model.transform(df, "_lp", "_hz"), time, event, F.col("_hz"), "_hz", ())
    curve = materialize(_cell_curve(cells).select("time", "_g", "_g_before"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("t")
    hazard = (model.baseline_hazard().select("time", "cumulative_hazard", grid)
              .groupBy("t").agg(F.max(F.when(F.col("time") <= F.col("t"), F.col("cumulative_hazard"))).alias("_h0")))
    free = (curve.select("time", "_g", grid)
            .groupBy("t").agg(F.min(F.when(F.col("time") <= F.col("t"), F.col("_g"))).alias("_g")))
    rows = (cells.join(curve.select("time", "_g_before"), "time").withColumn("t", grid)
            .join(hazard, "t").join(free, "t"))
    survival = F.exp(-F.coalesce(F.col("_h0"), F.lit(0.0)) * F.col("_hz"))
    died = (F.col("_e") == 1) & (F.col("time") <= F.col("t"))
    later = F.col("time") > F.col("t")
    loss = (F.when(died, survival * survival / F.col("_g_before"))
            .when(later, F.try_divide((1 - survival) * (1 - survival), F.coalesce(F.col("_g"), F.lit(1.0)))).otherwise(0.0))
    return rows.groupBy("t").agg((F.sum(loss * F.col("_n")) / F.sum("_n")).alias("brier"))


def brier_all_times(df: DataFrame, model: CoxModel | CoxStrata, time: str, event: str) -> DataFrame:
    """The Brier score of :func:`brier` at every distinct time of ``df``, events and losses; by stratum for several models.

    A row's loss depends on its hazard and on all times, so blocks of ``BLOCK`` counted rows meet blocks of ``BLOCK`` times as
    arrays inside a task, which gives only the sums of the block's losses at each time. No row for a hazard and a time exists.
    """
    by = [model.by] if isinstance(model, CoxStrata) else []
    cells = _counted(model.transform(df, "_lp", "_hz"), time, event, F.col("_hz"), "_hz", by)
    curve = materialize(_cell_curve(cells, by).select(*by, "_range", "time", "_g", "_g_before"))
    none = F.lit(0.0)
    steps = (model.baseline_hazard().select(*by, F.col("time").cast("double").alias("time"), F.col("hazard").cast("double").alias("_step"), none.alias("_g"), none.alias("_own"))
             .unionByName(curve.select(*by, "time", none.alias("_step"), "_g", F.lit(1.0).alias("_own")))
             .groupBy(*by, "time").agg(F.sum("_step").alias("_step"), F.max("_g").alias("_g"), F.max("_own").alias("_own")))
    hazard = running_totals(cut_axis(steps, "time"), "time", {"_h0": "_step"}, by, range_col="_range").filter("_own > 0")
    place = Window.partitionBy(*by, "_range").orderBy("time")
    point = F.struct("time", "_h0", "_g")
    blocks = (hazard.withColumn("_block", F.floor((F.row_number().over(place) - 1) / BLOCK)).groupBy(*by, "_range", "_block")
              .agg(F.sort_array(F.collect_list(point)).alias("_times")))  # BLOCK times at most
    number = Window.partitionBy(*by).orderBy("_range", "_block")  # a row for each block
    blocks = materialize(blocks.withColumn("_number", F.row_number().over(number)).select(*by, "_number", "_times"))
    most = blocks.agg(F.max("_number")).first()[0] or 0

    weighed = _matched(cells, curve.select(*by, "time", "_g_before"), [*by, "time"]).withColumn(
        "_w", F.when(F.col("_e") == 1, F.col("_n") / F.col("_g_before")).otherwise(0.0))
    row = F.struct(F.col("time").alias("t"), F.col("_hz").alias("h"), F.col("_n").cast("double").alias("n"), F.col("_w").alias("w"))
    pieces = (weighed.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*by, "_range").orderBy("time", "_hz", "_e")) - 1) / BLOCK))
              .groupBy(*by, "_range", "_block").agg(F.collect_list(row).alias("_rows")))
    pairs = _matched(pieces.withColumn("_number", F.explode(F.sequence(F.lit(1), F.lit(most)))) if most else pieces.withColumn("_number", F.lit(0)),
                     blocks, [*by, "_number"])

    @F.pandas_udf("array<double>")
    def losses(rows: pd.Series, times: pd.Series) -> pd.Series:
        out = []
        for r, t in zip(rows, times):
            left, h, n, w = (np.array([x[c] for x in r], dtype=float) for c in ("t", "h", "n", "w"))
            at, h0, g = (np.array([x[c] for x in t], dtype=float)[:, None] for c in ("time", "_h0", "_g"))
            survival = np.exp(-h0 * h)
            later = ((1 - survival) ** 2 * n * (left > at)).sum(axis=1)
            out.append((survival ** 2 * w * (left <= at)).sum(axis=1) + np.divide(later, g[:, 0], out=np.zeros(len(at)), where=later > 0))
        return pd.Series(out)

    lost = pairs.select(*by, F.explode(F.arrays_zip(F.col("_times.time").alias("t"), losses("_rows", "_times").alias("x"))).alias("_p"))
    total = cells.groupBy(*by).agg(F.sum("_n").alias("_all"))
    scores = lost.groupBy(*by, F.col("_p.t").alias("t")).agg(F.sum("_p.x").alias("_sum"))
    return _matched(scores.withColumn("_one", F.lit(1)), total.withColumn("_one", F.lit(1)), [*by, "_one"]).select(
        *by, "t", (F.col("_sum") / F.col("_all")).alias("brier"))


def integrated_brier(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid mean of the Brier scores over their time span."""
    by = list(by)
    steps = previous(cut_axis(scores, "t"), "t", ["t", "brier"], by)
    area = (F.col("brier") + F.col("_previous_brier")) / 2 * (F.col("t") - F.col("_previous_t"))
    return steps.select(*by, "t", area.alias("_a")).groupBy(*by).agg(
        F.try_divide(F.sum("_a"), F.max("t") - F.min("t")).alias("ibs"))


def _by_digits(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row once for each binary digit of the rank of its value, with the digits above as ``_prefix`` and the digit as ``_bit``.

    Two ranks differ first at one digit, where they share the prefix. Two more rows have no digit: ``_digit`` -1 is
    for all rows together, -2 for rows of equal rank. Ranks are those within ``by``.
    """
    ranks = materialize(running_totals(cells.select(*by, value).distinct().withColumn("_one", F.lit(1).cast("long")), value, {"_rank": "_one"}, by))
    top = ranks.agg(F.max("_rank")).first()[0] or 1
    digits = max(1, int(top).bit_length())
    rows = _matched(cells, ranks.select(*by, value, "_rank"), [*by, value]).withColumn(
        "_digit", F.explode(F.sequence(F.lit(-2), F.lit(digits - 1))))
    prefix = F.when(F.col("_digit") == -2, F.col("_rank"))
    bit = None
    for d in range(digits):
        here = F.col("_digit") == d
        prefix = prefix.when(here, F.shiftright("_rank", d + 1))
        b = F.shiftright("_rank", d).bitwiseAND(F.lit(1).cast("long"))
        bit = F.when(here, b) if bit is None else bit.when(here, b)
    return rows.withColumns({"_prefix": prefix.otherwise(0), "_bit": bit})


def concordance(df: DataFrame, time: str, event: str, risk: str, by: Sequence[str] = ()) -> DataFrame:
    """Harrell's C: of all pairs whose order of events is known, the share where the earlier one had
    the higher risk; equal risks count half.

    Pairs are counted, never formed. Risks are ranked; two ranks differ first at one binary digit, so
    for every digit the rows that share the digits above it are ordered by time, and those with digit
    1 that had the event are matched against the running count of later rows with digit 0. That is
    one row per digit and data point, with running totals over time split into ranges.
    """
    by = list(by)
    rows = _by_digits(_counted(df, time, event, F.col(risk), "_r", by), "_r", by)
    low = F.coalesce(F.col("_bit") == 0, F.lit(True))
    high = F.coalesce(F.col("_bit") == 1, F.lit(True))
    per = materialize(rows.groupBy(*by, "_range", "_digit", "_prefix", "time").agg(
        F.sum(F.when(low, F.col("_n")).otherwise(0)).alias("_low"),
        F.sum(F.when(low & (F.col("_e") == 1), F.col("_n")).otherwise(0)).alias("_low_dead"),
        F.sum(F.when(high & (F.col("_e") == 1), F.col("_n")).otherwise(0)).alias("_high_dead")))
    run = running_totals(per, "time", {"_later": "_low"}, [*by, "_digit", "_prefix"], descending=True, range_col="_range")
    # those with the event at the same time are not comparable with each other
    pairs = F.col("_high_dead").cast("double") * (F.col("_later") - F.col("_low_dead"))
    kind = lambda cond: F.coalesce(F.sum(F.when(cond, pairs)), F.lit(0.0))
    out = run.groupBy(*by).agg(kind(F.col("_digit") >= 0).alias("concordant"), kind(F.col("_digit") == -2).alias("tied"),
                               kind(F.col("_digit") == -1).alias("comparable"))
    c = F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable"))
    return out.select(*by, "concordant", "tied", "comparable", c.alias("c_index"))


def subject_rows(long: DataFrame, key: str = "subject_id", order: Sequence[str] = ("week",),
                 cols: Sequence[str] = ("event_time", "event", "sex")) -> DataFrame:
    """One survival row per subject, its earliest measurement's.

    A minimum by the order columns: partial aggregates keep one row per subject and task.
    """
    pick = F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return long.groupBy(key).agg(pick).select(key, "_row.*")
