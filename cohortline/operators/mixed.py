"""Linear mixed model with a random intercept and slopes per subject.

Each subject is reduced to the cross-products of its rows by one Spark aggregation. Every pass of
the fit then reads that small table: per-subject solves of the size of the random part run on
batches in the tasks, and only summed matrices come back to the driver. Several models, such as those of the folds of a
cross-validation, are fitted side by side: a pass gives the sums of all that have not converged yet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.session import materialize



@dataclass
class MixedModel:
    fixed: list[str]
    random: list[str]
    coef: np.ndarray          # intercept first, on the original scale
    covariance: np.ndarray    # of the random effects, for centered and scaled columns
    sigma2: float
    loglik: float
    iterations: int
    converged: bool
    n_subjects: int
    n_rows: int
    group: str
    center: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    y_scale: float = field(repr=False)
    y: str
    y_center: float = field(repr=False)
    _beta: np.ndarray = field(repr=False)  # for centered and scaled columns, as the products are
    _products: DataFrame = field(repr=False)

    def fixed_part(self) -> Column:
        out = F.lit(float(self.coef[0]))
        for c, b in zip(self.fixed, self.coef[1:]):
            out = out + F.col(c).cast("double") * F.lit(float(b))
        return out

    def transform(self, df: DataFrame, name: str = "pred", with_random: bool = False, readings: DataFrame | None = None) -> DataFrame:
        """Predictions from the fixed part, plus the subject's own effects.

        The effects are those given the training rows, or given ``readings`` with the response, which may be of subjects
        that were not in training. Subjects without any have none.
        """
        if not with_random:
            return df.withColumn(name, self.fixed_part())
        effects = self.random_effects(readings)
        own = F.coalesce(F.col("b_intercept"), F.lit(0.0))
        for c in self.random:
            i = self.fixed.index(c)
            z = (F.col(c).cast("double") - F.lit(float(self.center[i]))) / F.lit(float(self.scale[i]))
            own = own + F.coalesce(F.col(f"b_{c}"), F.lit(0.0)) * z
        return df.join(effects, self.group, "left").select(*df.columns, (self.fixed_part() + own).alias(name))

    def summary(self) -> DataFrame:
        spark = self._products.sparkSession
        rows = [("fixed", n, float(b)) for n, b in zip(["intercept", *self.fixed], self.coef)]
        names = ["intercept", *self.random]
        rows += [("random_sd", n, float(np.sqrt(self.covariance[i, i]))) for i, n in enumerate(names)]
        rows += [("residual_sd", "residual", float(np.sqrt(self.sigma2))), ("fit", "loglik", float(self.loglik)),
                 ("fit", "iterations", float(self.iterations)), ("fit", "subjects", float(self.n_subjects)),
                 ("fit", "rows", float(self.n_rows)), ("fit", "converged", float(self.converged))]
        return spark.createDataFrame(rows, "part string, term string, value double")

    def random_effects(self, readings: DataFrame | None = None) -> DataFrame:
        """Predicted effects of each subject of the training rows or of ``readings``, for centered and scaled columns."""
        products = self._products if readings is None else _products(
            readings, self.y, self.fixed, [self.group], self.center, self.scale, self.y_center, self.y_scale)
        p = len(self.fixed) + 1
        zi = _random_index(self.fixed, self.random)
        unit = self.y_scale
        beta, d, s2, group = self._beta, self.covariance / unit ** 2, self.sigma2 / unit ** 2, self.group
        names = [f"b_{n}" for n in ["intercept", *self.random]]

        def solve(batches):
            for pdf in batches:
                m = _matrices(pdf, p)
                b = _posterior(m, zi, p, beta, d, s2) * unit
                yield pd.concat([pdf[[group]].reset_index(drop=True), pd.DataFrame(b, columns=names)], axis=1)

        kind = products.schema[group].dataType.simpleString()
        return products.mapInPandas(solve, f"{group} {kind}, " + ", ".join(f"{n} double" for n in names))


def _random_index(fixed: Sequence[str], random: Sequence[str]) -> np.ndarray:
    return np.array([0] + [1 + list(fixed).index(c) for c in random])


def _pairs(p: int) -> list[tuple[int, int]]:
    """Upper triangle of the cross-product matrix of (intercept, fixed columns, response)."""
    return [(i, j) for i in range(p + 1) for j in range(i, p + 1)]


def _products(rows: DataFrame, y: str, fixed: Sequence[str], keys: Sequence[str], center, scale, y_center: float, y_scale: float) -> DataFrame:
    """Cross-products of each subject's complete rows, with centered and scaled columns."""
    rows = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*fixed, y]]).dropna()
    v = [F.lit(1.0)] + [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(fixed, center, scale)]
    v.append((F.col(y) - F.lit(float(y_center))) / F.lit(float(y_scale)))
    return rows.groupBy(*keys).agg(*[F.sum(v[i] * v[j]).alias(f"c_{i}_{j}") for i, j in _pairs(len(fixed) + 1)])


def _matrices(pdf: pd.DataFrame, p: int) -> np.ndarray:
    out = np.empty((len(pdf), p + 1, p + 1))
    for i, j in _pairs(p):
        out[:, i, j] = out[:, j, i] = pdf[f"c_{i}_{j}"].to_numpy(float)
    return out


def _posterior(m: np.ndarray, zi: np.ndarray, p: int, beta: np.ndarray, d: np.ndarray, s2: float):
    """Mean of every subject's effects given its data."""
    zz = m[:, zi[:, None], zi[None, :]]
    zr = m[:, zi, p] - m[:, zi, :p] @ beta
    a = np.linalg.inv(zz + s2 * np.linalg.inv(d))
    return np.einsum("nij,nj->ni", a, zr)


class _Scales:
    """Centers and scales of the columns; the fit does not depend on them, so several models share them."""

    def __init__(self, rows: DataFrame, y: str, fixed: Sequence[str]):
        ends = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(fixed)],
                        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(fixed)],
                        F.avg(y).alias("my"), F.var_pop(y).alias("vy")).first()
        if not ends["n"]:
            raise ValueError("no complete rows")
        self.center = np.array([ends[f"m_{i}"] for i in range(len(fixed))])
        self.scale = np.array([ends[f"s_{i}"] or 1.0 for i in range(len(fixed))])
        self.my, self.sy = ends["my"], np.sqrt(ends["vy"]) or 1.0


def _parts(p: int, q: int) -> dict[str, tuple]:
    return {"ll": (), "subjects": (), "gx": (p, p), "gy": (p,), "second": (q, q), "resid": (), "score": (q, q),
            "cross": (q, q), "info": (q, q, q, q), "score_s": (), "info_s": ()}


def _sums(m: np.ndarray, zi: np.ndarray, p: int, beta: np.ndarray, d: np.ndarray, s2: float) -> dict[str, np.ndarray]:
    """Log-likelihood, least-squares parts, EM sums, score and information, summed over the subjects of ``m``."""
    q = len(zi)
    xx, xy, n = m[:, :p, :p], m[:, :p, p], m[:, 0, 0]
    xz, zz = m[:, :p, :][:, :, zi], m[:, zi[:, None], zi[None, :]]
    zy = m[:, zi, p]
    prec = zz + s2 * np.linalg.inv(d)
    a = np.linalg.inv(prec)
    zr = zy - (xz.transpose(0, 2, 1) @ beta)
    b = (a @ zr[:, :, None])[:, :, 0]
    rr = m[:, p, p] - 2 * xy @ beta + ((xx @ beta) * beta).sum(1)
    fit = rr - 2 * (b * zr).sum(1) + (b * (zz @ b[:, :, None])[:, :, 0]).sum(1)
    az = a @ zz
    tr1 = np.trace(az, axis1=1, axis2=2)
    tr2 = np.trace(az @ az, axis1=1, axis2=2)
    logdet = (n - q) * np.log(s2) + np.linalg.slogdet(d)[1] + np.linalg.slogdet(prec)[1]
    ll = -0.5 * (n * np.log(2 * np.pi) + logdet + (rr - (zr * b).sum(1)) / s2)
    # Z'V^-1 Z, Z'V^-1 r and Z'V^-2 Z, with V^-1 = (I - Z A Z') / s2
    keep = np.eye(q) - az
    zvz = zz @ keep / s2
    zvr = (zr - (zz @ b[:, :, None])[:, :, 0]) / s2
    zv2z = keep.transpose(0, 2, 1) @ zz @ keep / s2 ** 2
    return {
        "ll": ll.sum(), "each": ll, "subjects": len(m),
        "gx": (xx - xz @ a @ xz.transpose(0, 2, 1)).sum(0) / s2,
        "gy": (xy - (xz @ (a @ zy[:, :, None]))[:, :, 0]).sum(0) / s2,
        "second": b.T @ b + s2 * a.sum(0), "resid": fit.sum() + s2 * tr1.sum(),
        "score": (zvr.T @ zvr - zvz.sum(0)) / 2, "cross": zv2z.sum(0) / 2,
        "info": np.tensordot(zvz, zvz, axes=(0, 0)) / 2,
        "score_s": (fit.sum() / s2 ** 2 - (n - tr1).sum() / s2) / 2,
        "info_s": (n - 2 * tr1 + tr2).sum() / s2 ** 2 / 2}


def _one_pass(products: DataFrame, by: str, p: int, zi: np.ndarray, at: dict[object, list[tuple]]) -> dict[object, list[dict[str, np.ndarray]]]:
    """The sums of each model at each of its points, in one job; a row for each point and task comes out."""
    parts = _parts(p, len(zi))
    lengths = {k: int(np.prod(shape)) for k, shape in parts.items()}
    size = sum(lengths.values())
    kind = products.schema[by].dataType.simpleString()

    def sums(batches):
        totals = {}
        for pdf in batches:
            for stratum, group in pdf.groupby(by, sort=False):
                m = _matrices(group, p)
                for i, point in enumerate(at[stratum]):
                    out = _sums(m, zi, p, *point)
                    totals[stratum, i] = totals.get((stratum, i), 0.0) + np.concatenate([np.ravel(out[k]) for k in parts])
        yield pd.DataFrame([[*at, *t] for at, t in totals.items()], columns=[by, "point", *[f"t{i}" for i in range(size)]])

    part = products.filter(F.col(by).isin(list(at))).mapInPandas(sums, f"`{by}` {kind}, point int, " + ", ".join(f"t{i} double" for i in range(size)))
    cuts = np.cumsum([0, *lengths.values()])
    found = {s: [{}] * len(points) for s, points in at.items()}
    for row in part.groupBy(by, "point").agg(*[F.sum(f"t{i}") for i in range(size)]).collect():  # a row for each point
        values = np.array(row[2:], dtype=float)
        found[row[0]][row[1]] = {k: values[cuts[i]:cuts[i + 1]].reshape(shape) for i, (k, shape) in enumerate(parts.items())}
    return found


class _Search:
    """The greatest likelihood of one model, from several points in each pass.

    From the best point so far go a scoring step for the covariance and half of it, with eigenvalues kept above a floor;
    the EM step, which cannot lower the likelihood; and damped scoring steps for the Cholesky factor, which stay inside
    the allowed region and so do well where a variance vanishes. The damping follows the step that did best.
    """

    def __init__(self, total: np.ndarray, p: int, q: int, floor: float, tol: float):
        self.q, self.floor, self.tol = q, floor, tol
        self.n = total[0, 0]
        self.beta = np.linalg.lstsq(total[:p, :p], total[:p, p], rcond=None)[0]  # start at least squares
        self.s2 = max(floor, (total[p, p] - total[:p, p] @ self.beta) / self.n) / 2
        self.d = np.eye(q) * max(floor, self.s2) / q
        self.converged, self.passes, self.ll, self.subjects, self.damping = False, 0, -np.inf, 0, 0.01
        self.points = [(self.beta, self.d, self.s2)]

    def take(self, results: list[dict[str, np.ndarray]]) -> None:
        self.passes += 1
        worth = [float(t["ll"]) if t and np.isfinite(t["ll"]) else -np.inf for t in results]
        best = int(np.argmax(worth))
        gain = worth[best] - self.ll
        if gain > 0:
            self.ll, self.subjects = worth[best], int(results[best]["subjects"])
            self.beta, self.d, self.s2 = self.points[best]
            self.damping = min(1e3, max(1e-6, self.damping * {3: 0.1, 5: 10.0}.get(best, 1.0)))
        if gain < self.tol * abs(self.ll):
            self.converged = self.passes > 1
        if gain > 0:
            self.points = self._propose(results[best])

    def _scored(self, t: dict[str, np.ndarray], ways: list[np.ndarray], unit: float) -> tuple[np.ndarray, np.ndarray]:
        """Score and information along symmetric directions of the covariance and, last, the residual variance."""
        k = len(ways)
        info, score = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        for i, e in enumerate(ways):
            score[i] = (e * t["score"]).sum()
            info[i, k] = info[k, i] = (e * t["cross"]).sum() * unit
            for j, f in enumerate(ways):
                info[i, j] = np.einsum("ab,bcda,cd->", e, t["info"], f)
        score[k], info[k, k] = t["score_s"] * unit, t["info_s"] * unit ** 2
        return score, info

    def _propose(self, t: dict[str, np.ndarray]) -> list[tuple]:
        q, floor = self.q, self.floor
        beta = np.linalg.lstsq(t["gx"], t["gy"], rcond=None)[0]
        entries = [(i, j) for i in range(q) for j in range(i + 1)]
        basis = []
        for i, j in entries:
            e = np.zeros((q, q))
            e[i, j] = e[j, i] = 1.0
            basis.append(e)
        score, info = self._scored(t, basis, 1.0)
        step = np.linalg.lstsq(info, score, rcond=None)[0]
        points = []
        for share in (1.0, 0.5):
            value, vector = np.linalg.eigh(self.d + share * sum(x * e for x, e in zip(step, basis)))
            points.append((beta, (vector * np.maximum(value, floor)) @ vector.T, max(floor, self.s2 + share * step[-1])))
        moment = t["second"] / self.subjects
        points.append((beta, (moment + moment.T) / 2 + np.eye(q) * floor, max(floor, float(t["resid"]) / self.n)))
        factor = np.linalg.cholesky(self.d + np.eye(q) * floor)
        ways = []
        for i, j in entries:
            e = np.zeros((q, q))
            e[i] = factor[:, j]
            ways.append(e + e.T)
        score, info = self._scored(t, ways, self.s2)
        for damping in (self.damping / 10, self.damping, self.damping * 10):
            step = np.linalg.lstsq(info + damping * np.diag(info).max() * np.eye(len(info)), score, rcond=None)[0]
            moved = factor.copy()
            for x, (i, j) in zip(step, entries):
                moved[i, j] += x
            points.append((beta, moved @ moved.T + np.eye(q) * floor, max(floor, self.s2 * float(np.exp(np.clip(step[-1], -3, 3))))))
        return points


def _fit(products: DataFrame, by: str, scales: _Scales, y: str, fixed: list[str], random: list[str], group: str,
         max_iter: int, tol: float, floor: float) -> dict[object, MixedModel]:
    """A model for each value of ``by`` in a table of cross-products."""
    p, q = len(fixed) + 1, len(random) + 1
    zi = _random_index(fixed, random)
    totals = products.groupBy(by).agg(*[F.sum(f"c_{i}_{j}").alias(f"c_{i}_{j}") for i, j in _pairs(p)]).toPandas()  # a row for each model
    searches = {s: _Search(m, p, q, floor, tol) for s, m in zip(totals[by].tolist(), _matrices(totals, p))}
    while at := {s: x.points for s, x in searches.items() if not x.converged and x.passes < max_iter}:
        for s, t in _one_pass(products, by, p, zi, at).items():
            searches[s].take(t)
    models = {}
    for s, x in searches.items():
        slope = x.beta[1:] / scales.scale * scales.sy
        intercept = scales.my + scales.sy * x.beta[0] - float(slope @ scales.center)
        models[s] = MixedModel(fixed, random, np.concatenate([[intercept], slope]), x.d * scales.sy ** 2, x.s2 * scales.sy ** 2,
                               x.ll - x.n * np.log(scales.sy), x.passes, x.converged, x.subjects, int(x.n), group, scales.center, scales.scale,
                               float(scales.sy), y, float(scales.my), x.beta, products.filter(F.col(by) == F.lit(s)).drop(by))
    return models


def _complete(df: DataFrame, y: str, fixed: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return materialize(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*fixed, y]]).dropna())


def mixed_model(df: DataFrame, y: str, fixed: Sequence[str], random: Sequence[str], group: str,
                max_iter: int = 500, tol: float = 1e-9, floor: float = 1e-8) -> MixedModel:
    """Maximum likelihood by Fisher scoring. Rows with a missing value are left out.

    The random part is an intercept and the ``random`` columns, which must be among ``fixed``. A
    step that lowers the likelihood is taken back and replaced by the EM step of the same pass.
    Variances are kept above ``floor``. Stops when the log-likelihood changes by less than ``tol``
    of its size; ``converged`` tells whether it did within ``max_iter`` passes.
    """
    fixed, random = list(fixed), list(random)
    rows = _complete(df, y, fixed, [group])
    scales = _Scales(rows, y, fixed)
    products = _products(rows, y, fixed, [group], scales.center, scales.scale, scales.my, scales.sy)
    return _fit(materialize(products.withColumn("_model", F.lit(0))), "_model", scales, y, fixed, random, group, max_iter, tol, floor)[0]


def subject_likelihoods(df: DataFrame, y: str, fixed: Sequence[str], random: Sequence[str], group: str,
                        coef: Sequence[float], covariance: Sequence[Sequence[float]], sigma2: float) -> DataFrame:
    """Log-likelihood and number of complete rows of each subject at given parameters, on the original scale.

    ``coef`` begins with the intercept, ``covariance`` is of the intercept and the ``random`` columns.
    """
    fixed, p = list(fixed), len(fixed) + 1
    zi, beta, d = _random_index(fixed, random), np.array(coef, dtype=float), np.array(covariance, dtype=float)
    products = _products(df, y, fixed, [group], [0.0] * (p - 1), [1.0] * (p - 1), 0.0, 1.0)

    def worth(batches):
        for pdf in batches:
            m = _matrices(pdf, p)
            yield pd.DataFrame({group: pdf[group].to_numpy(), "n": m[:, 0, 0].astype(np.int64), "loglik": _sums(m, zi, p, beta, d, sigma2)["each"]})

    kind = products.schema[group].dataType.simpleString()
    return products.mapInPandas(worth, f"`{group}` {kind}, n long, loglik double")


@dataclass
class MixedFolds:
    """Models that each leave out one fold of the subjects."""

    fold: str
    models: dict[object, MixedModel]
    _products: DataFrame = field(repr=False)  # of all subjects, by group and fold

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pred``, the fixed part under the model that did not see them, and ``own``, with the subject's effects."""
        first = next(iter(self.models.values()))
        fixed, random, group, fold = first.fixed, first.random, first.group, self.fold
        coef = F.create_map(*[x for f, m in self.models.items() for x in (F.lit(f), F.array(*[F.lit(float(b)) for b in m.coef]))])
        at = F.try_element_at(coef, F.col(fold))
        pred = F.get(at, F.lit(0))
        for i, c in enumerate(fixed):
            pred = pred + F.col(c).cast("double") * F.get(at, F.lit(i + 1))
        p, zi, unit = len(fixed) + 1, _random_index(fixed, random), first.y_scale
        given = {f: (m._beta, m.covariance / unit ** 2, m.sigma2 / unit ** 2) for f, m in self.models.items()}

        def solve(batches):
            for pdf in batches:
                for f, part in pdf.groupby(fold, sort=False):
                    if f in given:
                        b = _posterior(_matrices(part, p), zi, p, *given[f]) * unit
                        yield pd.DataFrame({group: part[group].to_numpy(), "_effects": list(b)})

        kind = self._products.schema[group].dataType.simpleString()
        effects = self._products.mapInPandas(solve, f"`{group}` {kind}, _effects array<double>").withColumnRenamed(group, "_of")
        own = F.coalesce(F.get("_effects", F.lit(0)), F.lit(0.0))
        for k, c in enumerate(random):
            i = fixed.index(c)
            z = (F.col(c).cast("double") - F.lit(float(first.center[i]))) / F.lit(float(first.scale[i]))
            own = own + F.coalesce(F.get("_effects", F.lit(k + 1)), F.lit(0.0)) * z
        scored = rows.withColumn("pred", pred).join(effects, F.col(group) == F.col("_of"), "left")
        return scored.withColumn("own", F.col("pred") + own).select(*rows.columns, "pred", "own")


def mixed_folds(df: DataFrame, y: str, fixed: Sequence[str], random: Sequence[str], group: str, fold: str,
                max_iter: int = 500, tol: float = 1e-9, floor: float = 1e-8) -> MixedFolds:
    """For each value of ``fold`` the model of the subjects of all other folds, all fitted side by side.

    A subject belongs to one fold. Its cross-products are made once and count in the models of the other folds.
    """
    fixed, random = list(fixed), list(random)
    rows = _complete(df, y, fixed, [group, fold])
    scales = _Scales(rows, y, fixed)
    products = materialize(_products(rows, y, fixed, [group, fold], scales.center, scales.scale, scales.my, scales.sy))
    folds = [r[0] for r in products.select(fold).distinct().collect()]  # one number for each fold
    others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(fold))
    trained = materialize(products.withColumn("_model", F.explode(others)).drop(fold))
    return MixedFolds(fold, _fit(trained, "_model", scales, y, fixed, random, group, max_iter, tol, floor), products)
