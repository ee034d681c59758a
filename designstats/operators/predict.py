"""Predictions with delta-method errors, as plain column expressions.

The coefficients and their covariance enter as literals, so a prediction is one projection
and runs on a five-row grid or on the whole table alike.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from designstats.operators.fitting import Fit, linear, num

Z = 1.96  # fixed value used for prediction bands


def differences(cumulative: Sequence[Column]) -> list[Column]:
    """Cumulative probabilities -> class probabilities (0 and 1 are added at the ends)."""
    ends = [F.lit(0.0), *cumulative, F.lit(1.0)]
    return [b - a for a, b in zip(ends, ends[1:])]


def named(fit: Fit, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the model columns of a fit as __x0, __x1, ..."""
    names = [f"__x{i}" for i in range(len(fit.columns))]
    return rows.withColumns(dict(zip(names, [c for _, c in fit.columns]))), names


def quadratic(x: Sequence[str], v: np.ndarray) -> str:
    """x' V x."""
    parts = [f"{x[i]} * {x[j]} * {num((1 if i == j else 2) * v[i, j])}" for i in range(len(x)) for j in range(i, len(x))]
    return " + ".join(["0D", *parts])


def standard_error(x: Sequence[str], v: np.ndarray) -> str:
    return f"sqrt(greatest({quadratic(x, v)}, 0D))"


def predict(fit: Fit, rows: DataFrame, se: bool = True, link: str = "link") -> DataFrame:
    """Add the linear predictor and its standard error to a grid or a table."""
    ready, x = named(fit, rows)
    p = len(x)
    added = [f"{linear(x, fit.coef[:p])} AS {link}"]
    if se:
        added.append(f"{standard_error(x, fit.vcov[:p, :p])} AS se")
    return ready.selectExpr("*", *added).drop(*x)


def band(rows: DataFrame, transform: str = "identity", z: float = Z) -> DataFrame:
    """predy, ll, ul from ``link`` and ``se`` on the scale of the response."""
    back = {
        "identity": lambda e: e,
        "logit": lambda e: 1.0 / (1.0 + F.exp(-e)),
        "log": F.exp,
    }[transform]
    link, se = F.col("link"), F.col("se")
    return rows.withColumns({"predy": back(link), "ll": back(link - z * se), "ul": back(link + z * se)})


def predict_response(fit: Fit, rows: DataFrame, out: str) -> DataFrame:
    """Predicted mean for every row (propensities and the like)."""
    ready, x = named(fit, rows)
    form = {"binomial": "1D / (1D + exp(-({eta})))", "poisson": "exp({eta})", "negbin": "exp({eta})"}.get(fit.family, "{eta}")
    return ready.selectExpr("*", form.format(eta=linear(x, fit.coef[: len(x)])) + f" AS {out}").drop(*x)


def _long(rows: DataFrame, keep: Sequence[str], names: Sequence[str], point, low, high) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(n).alias("name"), p.alias("predy"), F.least(a, b).alias("ll"),
                 F.greatest(a, b).alias("ul"))
        for n, p, a, b in zip(names, point, low, high)
    ])
    return rows.select(*keep, F.inline(cells))


def predict_ordinal(fit: Fit, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Class probabilities with limits, one row per input row and class.

    Limits are taken on the cumulative scale and then differenced; they order the band but
    are not intervals of the class probability itself.
    """
    rows, x = named(fit, rows)
    p, cuts = len(x), fit.extra["n_cut"]
    point, low, high = [], [], []
    cdf = lambda e: F.expr(f"1D / (1D + exp(-({e})))")
    for j in range(cuts):
        link = f"{num(fit.coef[p + j])} - ({linear(x, fit.coef[:p])})"
        picked = [*range(p), p + j]
        v = fit.vcov[np.ix_(picked, picked)].copy()
        v[:p, p] *= -1.0  # the cut enters with the opposite sign of the slopes
        v[p, :p] *= -1.0
        se = standard_error([*x, "1D"], v)
        point.append(cdf(link))
        low.append(cdf(f"{link} - {Z} * {se}"))
        high.append(cdf(f"{link} + {Z} * {se}"))
    names = [str(v) for v in fit.extra["levels"]]
    return _long(rows, keep, names, differences(point), differences(low), differences(high))


def predict_multinomial(fit: Fit, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Class probabilities with limits; every category uses its own standard error."""
    rows, x = named(fit, rows)
    p, k = fit.extra["p"], len(fit.extra["levels"])

    def softmax(shift: float) -> list[Column]:
        parts = ["1D"]
        for c in range(1, k):
            at = slice((c - 1) * p, c * p)
            move = f" + {num(shift)} * {standard_error(x, fit.vcov[at, at])}" if shift else ""
            parts.append(f"exp({linear(x, fit.coef[at])}{move})")
        return [F.expr(f"{part} / ({' + '.join(parts)})") for part in parts]

    names = [str(v) for v in fit.extra["levels"]]
    return _long(rows, keep, names, softmax(0.0), softmax(-Z), softmax(Z))
