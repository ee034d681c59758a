"""Weight rescaling and two-level linear models.

A cluster enters the Gaussian likelihood only through its weighted cross-products. They are
summed once per cluster (map-side first, so a huge cluster is no hot spot); every likelihood
step is then an aggregate over the cluster table, never over the rows.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from designstats.functions import dist
from designstats.operators.fitting import linear, num
from designstats.operators.frame import count, group_attach
from designstats.operators.terms import expand


def rescale_weights(df: DataFrame, cluster: str, w: str) -> DataFrame:
    """Level-1 weights summing to the cluster size (aw1) or to its effective size (bw1)."""
    x = F.col(w)
    t = group_attach(df, [cluster], __s=F.sum(x), __q=F.sum(x * x), __n=F.count(F.lit(1)))
    return t.withColumns({
        "aw1": x * F.col("__n") / F.col("__s"), "bw1": x * F.col("__s") / F.col("__q")
    }).drop("__s", "__q", "__n")


def cluster_weights(rows: DataFrame, cluster: str, keys: Sequence[str], population: DataFrame,
                    value: str = "value") -> DataFrame:
    """Level-2 weight per key cell: population share over share of sampled clusters."""
    pop = population.groupBy(*keys).agg(F.sum(value).alias("n"))
    total = pop.agg(F.sum("n").alias("s")).scalar()
    pop = pop.select(*keys, (F.col("n") / total).alias("pop_share"))
    sampled = count(rows.select(cluster, *keys).distinct(), *keys)
    total = sampled.agg(F.sum("n").alias("s")).scalar()
    sampled = sampled.select(*keys, (F.col("n") / total).alias("sample_share"))
    both = sampled.join(pop, list(keys), "full")
    return both.select(*keys, (F.col("pop_share") / F.col("sample_share")).alias("w2"))


def centre_within(df: DataFrame, cluster: str, x: str, out: str) -> DataFrame:
    t = group_attach(df, [cluster], __m=F.avg(x))
    return t.withColumn(out, F.col(x) - F.col("__m")).drop("__m")


@dataclass
class MixedFit:
    """Fixed effects with model-based and cluster-robust errors, and variance components."""

    terms: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    robust: np.ndarray
    components: dict[str, float]
    component_vcov: np.ndarray
    n: int
    clusters: int
    deviance: float
    gradient: np.ndarray

    def tidy(self, spark, robust: bool = False) -> DataFrame:
        v = self.robust if robust else self.vcov
        rows = [("fixed", t, float(b), float(s), float(b / s))
                for t, b, s in zip(self.terms, self.coef, np.sqrt(np.diag(v)))]
        rows += [("ran_pars", k, float(x), None, None) for k, x in self.components.items()]
        return spark.createDataFrame(rows, "effect string, term string, estimate double, std_error double, statistic double")

    def wald(self, terms: Sequence[str], values: Sequence[float] | None = None, robust: bool = True) -> dict:
        """Joint test of fixed effects against given values (zero by default)."""
        at = [self.terms.index(t) for t in terms]
        v = (self.robust if robust else self.vcov)[np.ix_(at, at)]
        return _wald(self.coef[at], v, values)

    def wald_components(self, names: Sequence[str] | None = None, values=None) -> dict:
        """The same for variance components (all but the residual by default)."""
        known = list(self.components)
        names = known[:-1] if names is None else list(names)
        at = [known.index(n) for n in names]
        return _wald(np.array([self.components[n] for n in names]), self.component_vcov[np.ix_(at, at)], values)


def _wald(estimate, v, values) -> dict:
    gap = estimate - (np.zeros(len(estimate)) if values is None else np.asarray(values, float))
    chisq = float(gap @ np.linalg.solve(v, gap))
    return {"chisq": chisq, "df": len(gap), "p": dist.chi2_sf(chisq, len(gap))}


def variance_reduction(null: MixedFit, fit: MixedFit) -> dict:
    """Proportional reduction of each variance component both models have."""
    return {k: 1 - fit.components[k] / null.components[k] for k in fit.components if k in null.components}


class _ClusterTable:
    """Weighted cross-products of (x, y) per cluster and the algebra on top of them."""

    def __init__(self, df, cluster, y, columns, w1, w2, slope):
        self.p, self.z = len(columns), [0] if slope is None else [0, slope]
        v = [c for _, c in columns] + [F.col(y).cast("double")]
        w = F.lit(1.0) if w1 is None else F.col(w1).cast("double")
        rows = df.select(F.col(cluster).alias("cluster"), w.alias("w"),
                         (F.lit(1.0) if w2 is None else F.col(w2).cast("double")).alias("w2"),
                         *[c.alias(f"v{i}") for i, c in enumerate(v)]).dropna()
        sums = [F.expr(f"sum(w * v{i} * v{j}) AS s{i}_{j}") for i in range(self.p + 1) for j in range(i, self.p + 1)]
        self.table = rows.groupBy("cluster").agg(
            F.first("w2").alias("w2"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), *sums).persist()
        one = self.table.selectExpr("sum(n) AS n", "count(1) AS c", "sum(w2 * w) AS w").first()
        self.n, self.clusters, self.weight = int(one.n), int(one.c), float(one.w)

    @staticmethod
    def s(i, j) -> str:
        return f"s{min(i, j)}_{max(i, j)}"

    def at(self, points: Sequence[Sequence[float]], ratio: bool = True) -> DataFrame:
        """Cluster table at several parameter points: u<k>_<a>, b<k>, ld and q<a>_<b>.

        A point holds the variance ratios, or (``ratio=False``) the variances with the residual
        variance last. With S the weighted cross-products of the random-effect columns and L
        the diagonal matrix of the ratios, u = (I + S L)^-1 S, ld = log det(I + L S), and q is
        the cross-product of everything after the random effects are integrated out.
        """
        m, z = self.p + 1, self.z
        tried = ", ".join(f"named_struct('i', {i}, 'v', array({', '.join(num(x) for x in pt)}))" for i, pt in enumerate(points))
        rows = self.table.selectExpr("*", f"inline(array({tried})) AS (i, point)")
        lam = [f"point[{k}]" + ("" if ratio else f" / point[{len(z)}]") for k in range(len(z))]
        rows = rows.selectExpr("*", *[f"{e} AS lam{k}" for k, e in enumerate(lam)])
        s = self.s
        if len(z) == 1:
            rows = rows.selectExpr("*", f"1 + lam0 * {s(z[0], z[0])} AS det")
            u = {f"u0_{a}": f"{s(z[0], a)} / det" for a in range(m)}
        else:
            s11, s12, s22 = s(z[0], z[0]), s(z[0], z[1]), s(z[1], z[1])
            rows = rows.selectExpr("*", f"(1 + lam0 * {s11}) * (1 + lam1 * {s22}) - lam0 * lam1 * {s12} * {s12} AS det")
            u = {f"u0_{a}": f"((1 + lam1 * {s22}) * {s(z[0], a)} - lam1 * {s12} * {s(z[1], a)}) / det" for a in range(m)}
            u.update({f"u1_{a}": f"((1 + lam0 * {s11}) * {s(z[1], a)} - lam0 * {s12} * {s(z[0], a)}) / det" for a in range(m)})
        rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in u.items()])
        q = {f"q{a}_{b}": s(a, b) + "".join(f" - lam{k} * {s(z[k], a)} * u{k}_{b}" for k in range(len(z)))
             for a in range(m) for b in range(a, m)}
        return rows.selectExpr("*", "ln(det) AS ld", *[f"u{k}_{z[k]} AS b{k}" for k in range(len(z))],
                               *[f"{e} AS {n}" for n, e in q.items()])

    def evaluate(self, points: Sequence[Sequence[float]]) -> list[dict]:
        """Sums needed for the profile likelihood at several variance ratios, in one job."""
        m, effects = self.p + 1, range(len(self.z))
        sums = ["sum(w2 * ld) AS ld", *[f"sum(w2 * b{k}) AS b{k}" for k in effects]]
        sums += [f"sum(w2 * q{i}_{j}) AS q{i}_{j}" for i in range(m) for j in range(i, m)]
        sums += [f"sum(w2 * u{k}_{i} * u{k}_{j}) AS g{k}_{i}_{j}" for k in effects for i in range(m) for j in range(i, m)]
        rows = self.at(points).groupBy("i").agg(*[F.expr(e) for e in sums]).collect()
        found = {r.i: r for r in rows}
        return [self._profile(found[i]) for i in range(len(points))]

    def _profile(self, r) -> dict:
        p, m = self.p, self.p + 1
        full = lambda tag: np.array([[r[f"{tag}{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        q = full("q")
        a, beta = q[:p, :p], np.linalg.solve(q[:p, :p], q[:p, p])
        rss = float(q[p, p] - q[:p, p] @ beta)
        c = np.append(-beta, 1.0)
        g = [full(f"g{k}_") for k in range(len(self.z))]
        return {"beta": beta, "a": a, "rss": rss, "logdet": float(r["ld"]), "b": [float(r[f"b{k}"]) for k in range(len(g))],
                "u2": [float(c @ gk @ c) for gk in g], "gxx": [gk[:p, :p] for gk in g]}

    def gradient(self, e: dict, reml: bool) -> np.ndarray:
        size = self.weight - (self.p if reml else 0)
        out = []
        for k in range(len(self.z)):
            d = e["b"][k] - size * e["u2"][k] / e["rss"]
            if reml:
                d -= float(np.trace(np.linalg.solve(e["a"], e["gxx"][k])))
            out.append(d)
        return np.array(out)


def mixed(
    df: DataFrame,
    cluster: str,
    y: str,
    items: Sequence,
    slope: str | None = None,
    w1: str | None = None,
    w2: str | None = None,
    reml: bool | None = None,
    levels=None,
    max_iter: int = 40,
) -> MixedFit:
    """Random intercept (and an uncorrelated random slope), optionally with weights on both levels.

    Without weights the default is restricted, with weights pseudo maximum likelihood.
    """
    weighted = w1 is not None or w2 is not None
    reml = (not weighted) if reml is None else reml
    columns = expand(df, items, True, levels)
    names = [t for t, _ in columns]
    t = _ClusterTable(df, cluster, y, columns, w1, w2, None if slope is None else names.index(slope))
    try:
        lam = np.full(len(t.z), 0.1)
        free = np.ones(len(lam), dtype=bool)
        for _ in range(max_iter):
            h = np.maximum(lam * 1e-4, 1e-9)
            points = [lam] + [lam + h * (np.arange(len(lam)) == k) for k in range(len(lam))]
            evals = t.evaluate(points)
            g0 = t.gradient(evals[0], reml)
            jac = np.stack([(t.gradient(e, reml) - g0) / h[k] for k, e in enumerate(evals[1:])], 1)
            free &= ~((lam < 1e-8) & (g0 > 0))  # variance at its lower limit
            lam = np.where(free, lam, 0.0)
            if not free.any():
                break
            at = np.flatnonzero(free)
            sub = jac[np.ix_(at, at)]
            if np.all(np.linalg.eigvalsh(0.5 * (sub + sub.T)) > 0):
                move = -np.linalg.solve(sub, g0[at])
            else:
                move = -np.sign(g0[at]) * lam[at]
            new = np.clip(lam[at] + move, lam[at] / 8, lam[at] * 8)
            change = np.max(np.abs(new - lam[at]) / lam[at])
            lam[at] = new
            if change < 1e-9:
                break
        else:
            raise ArithmeticError(f"the fit has not converged in {max_iter} steps")
        e = t.evaluate([lam])[0]
        size = t.weight - (t.p if reml else 0)
        sigma2 = e["rss"] / size
        beta = e["beta"]
        tau2 = lam * sigma2
        deviance = size * (np.log(2 * np.pi * sigma2) + 1) + e["logdet"]
        if reml:
            deviance += float(np.linalg.slogdet(e["a"])[1])
        inv = np.linalg.inv(e["a"])
        robust = _robust_fixed(t, lam, beta, inv)
        comp_vcov = _component_vcov(t, beta, tau2, sigma2)
        labels = [f"{cluster}.{names[k]}" for k in t.z]
        return MixedFit(names, beta, inv * sigma2, robust, {**dict(zip(labels, map(float, tau2))), "Residual": float(sigma2)},
                        comp_vcov, t.n, t.clusters, float(deviance), t.gradient(e, reml) * free)
    finally:
        t.table.unpersist()


def _robust_fixed(t: _ClusterTable, lam, beta, inv) -> np.ndarray:
    """Cluster-robust covariance: inverse information around the sum of squared cluster scores."""
    q = lambda a, b: f"q{min(a, b)}_{max(a, b)}"
    scores = [f"w2 * ({q(a, t.p)}" + "".join(f" - {q(a, b)} * {num(beta[b])}" for b in range(t.p)) + f") AS r{a}" for a in range(t.p)]
    pairs = [(a, b) for a in range(t.p) for b in range(a, t.p)]
    one = t.at([lam]).selectExpr(*scores).selectExpr(*[f"sum(r{a} * r{b}) AS m{a}_{b}" for a, b in pairs]).first()
    meat = np.array([[one[f"m{min(a, b)}_{max(a, b)}"] for b in range(t.p)] for a in range(t.p)])
    return inv @ meat @ inv


def _component_vcov(t: _ClusterTable, beta, tau2, sigma2) -> np.ndarray:
    """Sandwich covariance of the variance components, from cluster scores of the likelihood."""
    k, m = len(t.z), t.p + 1
    point = np.append(tau2, sigma2)
    h = np.maximum(point * 1e-4, 1e-10)
    tried = [point] + [point + s * h * (np.arange(k + 1) == i) for i in range(k + 1) for s in (1, -1)]
    c = [*(-beta), 1.0]
    quad = " + ".join(f"q{min(i, j)}_{max(i, j)} * {num(c[i] * c[j])}" for i in range(m) for j in range(m))
    rows = t.at(tried, ratio=False).selectExpr(
        "*", f"point[{k}] AS v", f"{quad} AS quad",
        *[f"{linear([f'u{n}_{a}' for a in range(m)], c)} AS e{n}" for n in range(k)])
    inner = [f"(b{n} / v - e{n} * e{n} / (v * v))" for n in range(k)]
    scores = [f"w2 * -0.5D * {e} AS c{n}" for n, e in enumerate(inner)]
    rest = "".join(f" - lam{n} * {e}" for n, e in enumerate(inner))
    scores.append(f"w2 * -0.5D * (w / v - quad / (v * v){rest}) AS c{k}")
    sums = [f"sum(c{a}) AS t{a}" for a in range(k + 1)]
    sums += [f"sum(c{a} * c{b}) AS m{a}_{b}" for a in range(k + 1) for b in range(a, k + 1)]
    rows = {r.i: r for r in rows.selectExpr("i", *scores).groupBy("i").agg(*[F.expr(e) for e in sums]).collect()}
    total = lambda i: np.array([rows[i][f"t{a}"] for a in range(k + 1)])
    bread = np.stack([(total(1 + 2 * i) - total(2 + 2 * i)) / (2 * h[i]) for i in range(k + 1)], 1)
    meat = np.array([[rows[0][f"m{min(a, b)}_{max(a, b)}"] for b in range(k + 1)] for a in range(k + 1)])
    inv = np.linalg.pinv(-bread)
    return inv @ meat @ inv.T
