"""Linear, logistic and Poisson models, plain or design-based, and their tests."""

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from designstats.functions import dist
from designstats.functions.columns import col
from designstats.operators.design import Design
from designstats.operators.fitting import (
    Block, Fit, ModelRows, Step, influence_covariance, lgamma_sql, linear, model_rows, newton, step_sums,
)
from designstats.operators.terms import expand


# Mean, variance and log-likelihood (up to constants) per row, in terms of eta, mu, y, w.
FAMILIES = {
    "gaussian": ("eta", "1D", "-0.5D * w * (y - mu) * (y - mu)"),
    "binomial": ("1D / (1D + exp(-eta))", "mu * (1D - mu)",
                 "w * (y * eta - greatest(eta, 0D) - log1p(exp(-abs(eta))))"),
    "poisson": ("exp(eta)", "mu", "w * (y * eta - mu)"),
}


def _step(family: str, x: list[str], beta: np.ndarray) -> Step:
    mu, var, ll = FAMILIES[family]
    pre = [{"eta": linear(x, beta)}, {"mu": mu}, {"var": var}, {"v": "w * var", "r": "w * (y - mu)"}]
    extra = {"pearson": "try_divide(r * (y - mu), var)", "w": "w", "n": "1"}
    return Step(pre, [f"r * {c}" for c in x], [Block(0, 0, "v", x, x)], ll, extra)


# Parts of a Poisson fit that do not depend on the coefficients: summed once, after the steps.
SATURATED = "sum(CASE WHEN y > 0 THEN w * (y * ln(y) - y) ELSE 0D END)"
LOG_FACTORIAL = f"sum(w * {lgamma_sql('y + 1D')})"


def _first_guess(family: str, model: ModelRows) -> np.ndarray:
    """One weighted least-squares step from the observed values."""
    layers = {
        "gaussian": [{"v": "w", "z": "w * y"}],
        "binomial": [{"m": "(y + 0.5D) / 2D"}, {"v": "w * m * (1D - m)"},
                     {"z": "v * (ln(m / (1D - m)) + (y - m) / (m * (1D - m)))"}],
        "poisson": [{"m": "y + 0.1D"}, {"v": "w * m"}, {"z": "v * (ln(m) + (y - m) / m)"}],
    }
    x = model.x
    step = Step(layers[family], [f"z * {c}" for c in x], [Block(0, 0, "v", x, x)], "0D")
    rhs, info, _, _ = step_sums(model.rows, step, len(x))
    return np.linalg.solve(info, rhs)


def glm(
    data: Design | DataFrame,
    y: str | Column,
    items: Sequence,
    family: str = "gaussian",
    weights: str | None = None,
    intercept: bool = True,
    levels: Mapping[str, Sequence] | None = None,
    quasi: bool = False,
) -> Fit:
    """Fit a model on a design (sandwich errors) or on a plain table (model errors).

    ``quasi`` estimates the dispersion of a plain binomial or Poisson fit; a design fit has
    the same coefficients and errors either way.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    frame = data.df if isinstance(data, Design) else data
    columns = expand(frame, items, intercept, levels)
    model = model_rows(data, col(y).cast("double"), columns, weights)
    x, p = model.x, len(columns)
    iterative = family != "gaussian"
    kept = iterative or model.design is not None  # rows that more than two passes read
    if kept:
        model.rows = model.rows.persist()
    try:
        start = _first_guess(family, model)
        build = lambda beta: _step(family, x, beta)
        if iterative:
            beta, score, info, ll, extra = newton(model, build, start)
        else:
            beta = start
            score, info, ll, extra = step_sums(model.rows, build(beta), p)
        naive = np.linalg.inv(info)
        n, sw = int(extra["n"]), float(extra["w"])
        deviance = -2.0 * ll
        if family == "poisson":
            fixed = model.rows.selectExpr(f"{SATURATED} AS sat", f"{LOG_FACTORIAL} AS lfact").first()
            deviance = 2.0 * (float(fixed.sat) - ll)
            ll = ll - float(fixed.lfact)
        if model.design is not None:
            meat = influence_covariance(model, build(beta))
            vcov = naive @ meat @ naive
            dispersion = float(extra["pearson"]) / sw * n / (n - 1)
            df = model.design.degf() + 1 - p
        else:
            scale = float(extra["pearson"]) / (n - p)
            dispersion = scale if family == "gaussian" or quasi else 1.0
            vcov = dispersion * naive
            # fixed-dispersion families are tested with the normal distribution
            df = float(n - p) if family == "gaussian" or quasi else dist.INF
    finally:
        if kept:
            model.rows.unpersist()
    if family == "gaussian" and model.design is None:
        s2 = deviance / n
        ll = -0.5 * n * (np.log(2 * np.pi * s2) + 1)
    if quasi:
        ll = float("nan")
    return Fit([t for t, _ in columns], beta, vcov, df, family, n, naive, deviance, ll, dispersion,
               {"sum_w": sw, "score": score, "intercept": intercept}, columns)


# -- fit measures and tests ------------------------------------------------------------
def r_squared(fit: Fit, null: Fit) -> float:
    """1 - residual over total sum of squares (plain linear model)."""
    return 1.0 - fit.deviance / null.deviance


def pseudo_r_squared(fit: Fit, null: Fit, digits: int | None = None) -> float:
    """1 - dispersion ratio; with ``digits`` the ratio is rounded before the subtraction."""
    ratio = fit.dispersion / null.dispersion
    return 1.0 - (round(ratio, digits) if digits is not None else ratio)


def aic(fit: Fit, k: float = 2.0) -> float:
    params = len(fit.terms) + (1 if fit.family == "gaussian" else 0)
    return -2.0 * fit.loglik + k * params


def bic(fit: Fit) -> float:
    return aic(fit, np.log(fit.n))


def anova_f(small: Fit, large: Fit) -> dict:
    """F test of nested plain linear models."""
    q = len(large.terms) - len(small.terms)
    f = (small.deviance - large.deviance) / q / large.dispersion
    return {"f": f, "df1": q, "df2": large.df, "p": dist.f_sf(f, q, large.df)}


def lr_test(small: Fit, large: Fit) -> dict:
    q = len(large.terms) - len(small.terms)
    stat = 2.0 * (large.loglik - small.loglik)
    return {"chisq": stat, "df": q, "p": dist.chi2_sf(max(stat, 0.0), q)}


def _index(fit: Fit, terms: Sequence[str]) -> list[int]:
    return [fit.terms.index(t) for t in terms]


def wald_test(fit: Fit, terms: Sequence[str], values: Sequence[float] | None = None,
              df: float | None = None) -> dict:
    """Are the given coefficients jointly equal to the values (zero by default)?"""
    at = _index(fit, terms)
    gap = fit.coef[at] - (np.zeros(len(at)) if values is None else np.asarray(values, float))
    chisq = float(gap @ np.linalg.solve(fit.vcov[np.ix_(at, at)], gap))
    df2 = fit.df if df is None else df
    f = chisq / len(at)
    return {"chisq": chisq, "f": f, "df1": len(at), "df2": df2, "p": dist.f_sf(f, len(at), df2),
            "p_chisq": dist.chi2_sf(chisq, len(at))}


def scaled(fit: Fit) -> tuple[float, np.ndarray]:
    """Deviance and naive covariance for weights rescaled to mean one."""
    mean_w = fit.extra["sum_w"] / fit.n
    return fit.deviance / mean_w, fit.naive * mean_w


def rao_scott_lrt(small: Fit, large: Fit, terms: Sequence[str] | None = None) -> dict:
    """Working likelihood-ratio test; its tail is a weighted sum of chi-squares."""
    terms = [t for t in large.terms if t not in small.terms] if terms is None else list(terms)
    at = _index(large, terms)
    _, naive = scaled(large)
    delta = np.linalg.solve(naive[np.ix_(at, at)], large.vcov[np.ix_(at, at)])
    lambdas = sorted(np.linalg.eigvals(delta).real, reverse=True)
    chisq = scaled(small)[0] - scaled(large)[0]
    return {"chisq": chisq, "lambdas": lambdas, "df1": len(at), "df2": large.df,
            "p": dist.mixture_sf(chisq, lambdas, large.df),
            "p_saddle": dist.saddlepoint_sf(chisq, lambdas, large.df)}


def design_aic(fit: Fit, k: float = 2.0) -> dict:
    """Deviance plus k times the trace of the design-effect matrix (Lumley and Scott 2015)."""
    at = [i for i, t in enumerate(fit.terms) if t != "(Intercept)"]
    deviance, naive = scaled(fit)
    if fit.family == "gaussian":
        deviance = fit.n * (np.log(2 * np.pi * deviance / fit.n) + 1)
        naive = naive * fit.dispersion
    if not at:
        return {"eff_p": 0.0, "aic": deviance, "deltabar": float("nan")}
    delta = np.linalg.solve(naive[np.ix_(at, at)], fit.vcov[np.ix_(at, at)])
    eff = float(np.trace(delta))
    return {"eff_p": eff, "aic": deviance + k * eff, "deltabar": eff / len(at)}


def design_bic(fit: Fit, maximal: Fit) -> float:
    """Wald distance to the maximal model plus a penalty in log n; same family required."""
    if fit.family != maximal.family:
        raise ValueError("the maximal model must be of the same family")
    left_out = [t for t in maximal.terms if t not in fit.terms]
    wald = wald_test(maximal, left_out)["chisq"] if left_out else 0.0
    return wald + len(fit.terms) * float(np.log(fit.n))


def compare_statistics(plain: Fit, survey: Fit, spark) -> DataFrame:
    """Test statistics of two fits next to each other."""
    a = plain.tidy(spark).select("term", F.col("statistic").alias("cs_no"))
    b = survey.tidy(spark).select("term", F.col("statistic").alias("cs_yes"))
    return a.join(b, "term")
