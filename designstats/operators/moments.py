"""Moment structures and recursive path models."""

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from designstats.functions import dist
from designstats.operators.design import PSU, STR, WT, Design
from designstats.operators.fitting import Fit, gram, linear, num, total_covariance
from designstats.operators.terms import expand


class Moments:
    """Weighted means and covariances of items, and the covariance of those moments."""

    def __init__(self, data: Design | DataFrame, items: Sequence[str], weights: str | None = None):
        self.items = list(items)
        self.design = data if isinstance(data, Design) else None
        rows = data.domain_rows() if self.design else data
        w = F.col(WT) if self.design else (F.lit(1.0) if weights is None else F.col(weights))
        keys = [STR, PSU] if self.design else []
        self.rows = rows.select(
            *keys, w.cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(items)]
        ).dropna()
        k = len(self.items)
        self.pairs = [(i, j) for i in range(k) for j in range(i, k)]
        means = self.rows.agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"),
            *[(F.sum(F.col("w") * F.col(f"x{i}")) / F.sum("w")).alias(f"m{i}") for i in range(k)],
        ).first()
        self.n, self.sum_w = int(means.n), float(means.w)
        self.mean = np.array([means[f"m{i}"] for i in range(k)])
        gaps = self._gaps()
        one = gaps.selectExpr(*[f"sum(w * g{i} * g{j}) AS p{i}_{j}" for i, j in self.pairs]).first()
        self.factor = self.n / (self.n - 1)
        self.cov = np.zeros((k, k))
        for i, j in self.pairs:
            self.cov[i, j] = self.cov[j, i] = one[f"p{i}_{j}"] / self.sum_w * self.factor

    def _gaps(self) -> DataFrame:
        keys = [STR, PSU] if self.design else []
        return self.rows.selectExpr(*keys, "w", *[f"x{i} - {num(m)} AS g{i}" for i, m in enumerate(self.mean)])

    @property
    def names(self) -> list[str]:
        """Means first, then covariances a~~b."""
        return [f"{a}~1" for a in self.items] + [f"{self.items[i]}~~{self.items[j]}" for i, j in self.pairs]

    def _influence(self) -> list[str]:
        w = f"w / {num(self.sum_w)}"
        out = [f"{w} * g{i}" for i in range(len(self.items))]
        return out + [f"{w} * ({num(self.factor)} * g{i} * g{j} - {num(self.cov[i, j])})" for i, j in self.pairs]

    def gamma(self) -> np.ndarray:
        """Covariance of the moments: between PSUs with a design, between rows without."""
        z = self._influence()
        names = [f"z{i}" for i in range(len(z))]
        gaps = self._gaps()
        if self.design is None:
            rows = gaps.selectExpr("1D AS one", *[f"{e} AS {n}" for e, n in zip(z, names)])
            return gram(rows, names, "one") * self.n / (self.n - 1)
        psu = gaps.groupBy(STR, PSU).agg(*[F.expr(f"sum({e}) AS {n}") for e, n in zip(z, names)])
        return total_covariance(self.design, psu, names)

    def table(self, spark) -> DataFrame:
        rows = [(self.items[i], self.items[j], float(self.cov[i, j]), float(self.mean[i])) for i, j in self.pairs]
        return spark.createDataFrame(rows, "a string, b string, cov double, mean_a double")


def path_model(data: Design | DataFrame, equations: Mapping[str, Sequence], levels=None,
               weights: str | None = None) -> Fit:
    """Recursive path model: each equation by weighted least squares, errors from stacked scores.

    All normal equations come from one pass; a second pass sums the influence of every
    coefficient per PSU. Parameters are named ``lhs~rhs``; residual variances ``lhs~~lhs``.
    """
    design = data if isinstance(data, Design) else None
    base = data.domain_rows() if design else data
    w = F.col(WT) if design else (F.lit(1.0) if weights is None else F.col(weights).cast("double"))
    keys = [STR, PSU] if design else []
    columns = {y: expand(base, items, True, levels) for y, items in equations.items()}
    flat, picked = {}, []
    for y, cols in columns.items():
        for i, (_, c) in enumerate(cols):
            flat[(y, i)] = f"x_{len(flat)}"
            picked.append(c.alias(flat[(y, i)]))
    outcome = {y: f"y_{i}" for i, y in enumerate(columns)}
    rows = base.select(*keys, w.alias("w"), *picked,
                       *[F.col(y).cast("double").alias(n) for y, n in outcome.items()]).dropna()
    wanted = ["sum(w) AS sw", "count(1) AS n"]
    for e, (y, cols) in enumerate(columns.items()):
        x = [flat[(y, i)] for i in range(len(cols))]
        for a, n in enumerate(x):
            wanted.append(f"sum(w * {n} * {outcome[y]}) AS b_{e}_{a}")
            wanted += [f"sum(w * {n} * {x[b]}) AS a_{e}_{a}_{b}" for b in range(a, len(x))]
    one = rows.selectExpr(*wanted).first()
    terms, coef, influence, residuals = [], [], [], []
    for e, (y, cols) in enumerate(columns.items()):
        p = len(cols)
        x = [flat[(y, i)] for i in range(p)]
        a = np.array([[one[f"a_{e}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        inv = np.linalg.inv(a)
        beta = inv @ np.array([one[f"b_{e}_{i}"] for i in range(p)])
        r = f"({outcome[y]} - ({linear(x, beta)}))"
        influence += [f"w * {r} * ({linear(x, inv[i])})" for i in range(p)]
        terms += [f"{y}~{'1' if t == '(Intercept)' else t}" for t, _ in cols]
        coef += list(beta)
        residuals.append((y, r))
    # residual variances (divisor: sum of weights, as in maximum likelihood)
    variances = rows.selectExpr(*[f"sum(w * {r} * {r}) / sum(w) AS v{i}" for i, (_, r) in enumerate(residuals)]).first()
    for i, (y, r) in enumerate(residuals):
        terms.append(f"{y}~~{y}")
        coef.append(float(variances[i]))
        influence.append(f"w * ({r} * {r} - {num(variances[i])}) / {num(one.sw)}")
    names = [f"u{i}" for i in range(len(influence))]
    z = rows.selectExpr(*keys, *[f"{c} AS {n}" for c, n in zip(influence, names)])
    if design is not None:
        vcov = total_covariance(design, z.groupBy(STR, PSU).agg(*[F.sum(n).alias(n) for n in names]), names)
    else:
        vcov = gram(z.withColumn("one", F.lit(1.0)), names, "one")
    return Fit(terms, np.array(coef, dtype=float), vcov, dist.INF, "path", int(one.n), vcov)


def defined_effects(fit: Fit, effects: Mapping[str, Callable[[Mapping[str, float]], float]]) -> Fit:
    """Functions of the coefficients (products, sums, differences) with delta-method errors."""
    point = dict(zip(fit.terms, fit.coef))
    values, rows = [], []
    for f in effects.values():
        values.append(f(point))
        gradient = []
        for t in fit.terms:
            h = 1e-6 * max(1.0, abs(point[t]))
            gradient.append((f({**point, t: point[t] + h}) - f({**point, t: point[t] - h})) / (2 * h))
        rows.append(gradient)
    g = np.array(rows)
    return Fit(list(effects), np.array(values), g @ fit.vcov @ g.T, dist.INF, "defined", fit.n, fit.naive)


def parameter_table(fit: Fit, spark) -> DataFrame:
    """lhs, op, rhs, est, se, z, pvalue."""
    rows = []
    for t, b, s, z, p in fit.rows():
        op = "~~" if "~~" in t else "~" if "~" in t else ":="
        lhs, rhs = t.split(op) if op != ":=" else (t, t)
        rows.append((lhs, "~1" if rhs == "1" else op, "" if rhs == "1" else rhs, b, s, z, p))
    return spark.createDataFrame(rows, "lhs string, op string, rhs string, est double, se double, z double, pvalue double")


def srmr(observed: DataFrame, implied: DataFrame) -> DataFrame:
    """Standardised root mean square residual from two long covariance tables (a, b, cov)."""
    both = observed.select("a", "b", F.col("cov").alias("s")).join(
        implied.select("a", "b", F.col("cov").alias("m")), ["a", "b"])
    diag = observed.where("a = b")
    left = diag.select("a", F.col("cov").alias("va"))
    right = diag.select(F.col("b"), F.col("cov").alias("vb"))
    gap = (F.col("s") - F.col("m")) / F.sqrt(F.col("va") * F.col("vb"))
    return both.join(left, "a").join(right, "b").agg(F.sqrt(F.avg(gap * gap)).alias("srmr"))
