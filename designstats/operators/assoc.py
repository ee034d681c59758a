"""Association tests: chi-square family, t tests, correlation, reliability."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from designstats.functions import dist
from designstats.functions.columns import col
from designstats.operators.design import PSU, STR, WT, Design
from designstats.operators.estimate import survey_means
from designstats.operators.fitting import total_covariance
from designstats.operators.frame import factor_levels

CHISQ_STATISTICS = ("Wald", "adjWald", "Chisq", "F", "lincom", "saddlepoint")


def chisq_counts(df: DataFrame, a: str, b: str) -> dict:
    """Pearson test on plain counts (continuity correction for 2 x 2 tables)."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count()
    rows = counts.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the table has too many cells for a contingency test")
    la, lb = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    o = np.zeros((len(la), len(lb)))
    for r in rows:
        o[la.index(r[0]), lb.index(r[1])] = r[2]
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    gap = np.abs(o - e)
    if o.shape == (2, 2):
        gap = gap - min(0.5, gap.min())
    stat = float((gap**2 / e).sum())
    df1 = (len(la) - 1) * (len(lb) - 1)
    return {"statistic": stat, "df": df1, "p": dist.chi2_sf(stat, df1)}


def _cells(design: Design, a: str, b: str):
    """Cell shares, their design covariance, the domain size and the numbers of levels."""
    narrowed = design.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = narrowed.domain_rows()
    la, lb = factor_levels(rows, a), factor_levels(rows, b)
    pairs = [(x, y) for x in la for y in lb]
    sums = [F.coalesce(F.sum(F.when((F.col(a) == x) & (F.col(b) == y), F.col(WT))), F.lit(0.0)).alias(f"c{i}")
            for i, (x, y) in enumerate(pairs)]
    psu = rows.groupBy(STR, PSU).agg(*sums, F.sum(WT).alias("w"), F.count(F.lit(1)).alias("n"))
    psu = psu.persist()
    try:
        names = [f"c{i}" for i in range(len(pairs))]
        total = psu.agg(*[F.sum(c).alias(c) for c in names], F.sum("w").alias("w"), F.sum("n").alias("n")).first()
        p = np.array([total[c] for c in names]) / total.w
        influence = [((F.col(c) - F.lit(float(q)) * F.col("w")) / F.lit(float(total.w))).alias(c)
                     for c, q in zip(names, p)]
        v = total_covariance(design, psu.select(STR, PSU, *influence), names)
    finally:
        psu.unpersist()
    return p, v, int(total.n), len(la), len(lb)


def survey_chisq(design: Design, a: str, b: str, statistics: Sequence[str] = CHISQ_STATISTICS) -> dict:
    """Wald and Rao-Scott tests of independence: name -> statistic, df1, df2, p."""
    p, v, n, nr, nc = _cells(design, a, b)
    nu = float(design.degf())
    grid = [(i, j) for i in range(nr) for j in range(nc)]
    table = p.reshape(nr, nc)
    row, column = table.sum(1), table.sum(0)
    q = (nr - 1) * (nc - 1)
    out = {}
    if "Wald" in statistics or "adjWald" in statistics:
        # gaps between observed and expected shares, linearised in the cell shares
        y, jac = [], []
        for i in range(nr - 1):
            for j in range(nc - 1):
                y.append(table[i, j] - row[i] * column[j])
                jac.append([float((r, c) == (i, j)) - (r == i) * column[j] - (c == j) * row[i]
                            for r, c in grid])
        y, jac = np.array(y), np.array(jac)
        wald = float(y @ np.linalg.solve(jac @ v @ jac.T, y))
        out["Wald"] = {"statistic": wald / q, "df1": q, "df2": nu, "p": dist.f_sf(wald / q, q, nu)}
        adjusted = wald * (nu - q + 1) / (nu * q)
        out["adjWald"] = {"statistic": adjusted, "df1": q, "df2": nu - q + 1,
                          "p": dist.f_sf(adjusted, q, nu - q + 1)}
    # main effects and interaction contrasts of the saturated model
    main = np.array([[1.0, *[float(i == r) for r in range(1, nr)], *[float(j == c) for c in range(1, nc)]]
                     for i, j in grid])
    inter = np.array([[float(i == r and j == c) for r in range(1, nr) for c in range(1, nc)] for i, j in grid])
    contrast = inter - main @ np.linalg.lstsq(main, inter, rcond=None)[0]
    inv = np.diag([0.0 if s == 0 else 1.0 / s for s in p])
    denominator = contrast.T @ (inv / n) @ contrast
    numerator = contrast.T @ inv @ v @ inv @ contrast
    delta = np.linalg.solve(denominator, numerator)
    lambdas = sorted(np.linalg.eigvals(delta).real, reverse=True)
    expected = np.outer(row, column)
    pearson = float(n * ((table - expected) ** 2 / expected).sum())
    trace, trace2 = float(np.trace(delta)), float(np.trace(delta @ delta))
    d0 = trace**2 / trace2
    mean = trace / q
    out["Chisq"] = {"statistic": pearson, "df1": q, "df2": dist.INF, "p": dist.chi2_sf(pearson / mean, q)}
    out["F"] = {"statistic": pearson / trace, "df1": d0, "df2": d0 * nu,
                "p": dist.f_sf(pearson / trace, d0, d0 * nu)}
    out["lincom"] = {"statistic": pearson, "df1": q, "df2": nu, "p": dist.mixture_sf(pearson, lambdas, nu)}
    out["saddlepoint"] = {"statistic": pearson, "df1": q, "df2": nu,
                          "p": dist.saddlepoint_sf(pearson, lambdas, nu)}
    for k in out:
        out[k]["deltabar"] = mean
    return {k: out[k] for k in statistics}


def chisq_comparison(design: Design, a: str, b: str) -> DataFrame:
    """p-values of all tests, smallest first."""
    spark = design.df.sparkSession
    rows = [("NoCS", chisq_counts(design.domain_rows(), a, b)["p"])]
    rows += [(k, v["p"]) for k, v in survey_chisq(design, a, b).items()]
    return spark.createDataFrame([(k, float(p)) for k, p in rows], "source string, pvalue double").orderBy("pvalue")


# -- t tests -----------------------------------------------------------------------------
def t_test(df: DataFrame, x: str | Column, mu: float = 0.0) -> DataFrame:
    """Plain one-sample (or, given a difference, paired) t test."""
    v = col(x).cast("double") - F.lit(mu)
    n = F.count(v)
    table = df.agg(F.avg(v).alias("estimate"), (F.stddev_samp(v) / F.sqrt(n)).alias("se"),
                   (n - 1).cast("double").alias("df"))
    return table.withColumn("t", F.col("estimate") / F.col("se"))


def survey_t_test(design: Design, x: str | Column, mu: float = 0.0) -> DataFrame:
    v = col(x).cast("double") - F.lit(mu)
    t = survey_means(design, {"x": v}, df=dist.INF)
    return t.select(F.col("mean").alias("estimate"), "se", F.lit(float(design.degf())).alias("df"),
                    (F.col("mean") / F.col("se")).alias("t"))


def welch_test(df: DataFrame, x: str, group: str, first, second) -> DataFrame:
    """Two-sample test without equal variances; estimate = mean(second) - mean(first)."""
    known = df.where(F.col(group).isin(first, second) & F.col(x).isNotNull())

    def part(level):
        v = F.when(F.col(group) == level, F.col(x).cast("double"))
        return F.avg(v), F.var_samp(v) / F.count(v), F.count(v)

    m1, e1, n1 = part(first)
    m2, e2, n2 = part(second)
    table = known.agg(m1.alias("m1"), e1.alias("e1"), n1.alias("n1"), m2.alias("m2"), e2.alias("e2"), n2.alias("n2"))
    e1, e2 = F.col("e1"), F.col("e2")
    df_ = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return table.select((F.col("m2") - F.col("m1")).alias("estimate"), F.sqrt(e1 + e2).alias("se"), df_.alias("df"),
                        ((F.col("m2") - F.col("m1")) / F.sqrt(e1 + e2)).alias("t"))


def survey_two_sample(design: Design, x: str, group: str, first, second) -> dict:
    """Difference of two domain means (the slope of a regression on the group)."""
    from designstats.operators.glm import glm
    from designstats.operators.terms import expr

    inside = design.filter(F.col(group).isin(first, second))
    fit = glm(inside, x, [expr("second", (F.col(group) == second).cast("double"))])
    name, estimate, se, t, p = fit.rows()[1]
    return {"estimate": estimate, "se": se, "df": float(fit.df), "t": t, "p": p}


# -- correlation ---------------------------------------------------------------------------
def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    t = known.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    stat = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return t.select("r", stat.alias("t"), (F.col("n") - 2).cast("double").alias("df"))


def survey_correlation(design: Design, x: str, y: str) -> DataFrame:
    """Weighted correlation; t uses the weights only, not the clusters."""
    rows = design.domain_rows().where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = F.col(WT)
    m = rows.agg(F.struct((F.sum(w * F.col(x)) / F.sum(w)).alias("x"), (F.sum(w * F.col(y)) / F.sum(w)).alias("y"))
                 .alias("m")).scalar()
    gaps = rows.withColumn("m", m).select(w.alias("w"), (F.col(x) - F.col("m.x")).alias("a"),
                                          (F.col(y) - F.col("m.y")).alias("b"))
    w, a, b = F.col("w"), F.col("a"), F.col("b")
    t = gaps.agg((F.sum(w * a * b) / F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias("r"),
                 F.count(F.lit(1)).alias("n"))
    r, n = F.col("r"), F.col("n")
    return t.select("r", (r / F.sqrt((1 - r * r) / (n - 2))).alias("t"), (n - 2).cast("double").alias("df"))


# -- reliability ---------------------------------------------------------------------------
def covariance_matrix(rows: DataFrame, items: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """Covariance of complete rows, one pass for the means and one for the products."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    known = rows.dropna(subset=list(items)).select(w.alias("w"), *[F.col(c).cast("double").alias(c) for c in items])
    means = known.agg(F.struct(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in items]).alias("m")).scalar()
    gaps = known.withColumn("m", means).select("w", *[(F.col(c) - F.col(f"m.`{c}`")).alias(f"g{i}") for i, c in enumerate(items)])
    k = len(items)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    one = gaps.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"),
                   *[F.sum(F.col("w") * F.col(f"g{i}") * F.col(f"g{j}")).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = one[f"p{i}_{j}"] / one.w * one.n / (one.n - 1)
    return out, int(one.n)


def alpha_from(c: np.ndarray) -> float:
    k = len(c)
    return k / (k - 1) * (1 - np.trace(c) / c.sum())


def cronbach_alpha(rows: DataFrame, items: Sequence[str]) -> dict:
    """Reliability of a scale: raw and standardised alpha, item-dropped values, errors."""
    c, n = covariance_matrix(rows, list(dict.fromkeys(items)))
    k = len(c)
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    mean_r = (r.sum() - k) / (k * (k - 1))
    smc = 1 - 1 / np.diag(np.linalg.pinv(r))
    total, trace = c.sum(), np.trace(c)
    q = 2 * k**2 / ((k - 1) ** 2 * total**3) * (
        total * (np.trace(c @ c) + trace**2) - 2 * trace * (c @ c).sum())
    dropped = {}
    names = list(dict.fromkeys(items))
    for i in range(k):
        keep = [j for j in range(k) if j != i]
        dropped[names[i]] = alpha_from(c[np.ix_(keep, keep)]) if k > 2 else float("nan")
    return {"raw_alpha": alpha_from(c), "std_alpha": k * mean_r / (1 + (k - 1) * mean_r), "average_r": mean_r,
            "g6": 1 - (1 - smc).sum() / r.sum(), "ase": float(np.sqrt(q / n)), "dropped": dropped, "n": n}


def survey_alpha(design: Design, items: Sequence[str]) -> float:
    """Alpha from design-weighted item variances and the variance of their sum."""
    c, _ = covariance_matrix(design.domain_rows(), list(dict.fromkeys(items)), WT)
    return float(alpha_from(c))
