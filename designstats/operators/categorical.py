"""Ordinal, multinomial and negative-binomial models, plain or design-based."""

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from designstats.functions import dist
from designstats.functions.columns import col
from designstats.operators.design import PSU, STR, Design
from designstats.operators.fitting import (
    Block, Fit, Step, digamma_sql, influence_covariance, lgamma_sql, linear, model_rows, newton, num, trigamma_sql,
)
from designstats.operators.frame import factor_levels
from designstats.operators.glm import LOG_FACTORIAL, glm
from designstats.operators.replicate import draw_counts
from designstats.operators.terms import expand

#: Row weights (rows x replicates) that a step holds at once, so that its passes over them stay near the processor.
CACHED = 1 << 16


def _codes(frame: DataFrame, y: str, levels: Sequence | None) -> tuple[list, Column]:
    """Levels and the 0-based code of the outcome."""
    levels = factor_levels(frame, y) if levels is None else list(levels)
    code = None
    for k, v in enumerate(levels):
        test = F.col(y) == F.lit(v)
        code = F.when(test, k) if code is None else code.when(test, k)
    return levels, code.cast("double")


def _finish(model, build, theta, info, labels, family, n, ll, extra) -> Fit:
    naive = np.linalg.inv(info)
    if model.design is not None:
        meat = influence_covariance(model, build(theta))
        vcov, df = naive @ meat @ naive, model.design.degf() + 1 - len(theta)
    else:
        vcov, df = naive, float(n - len(theta))
    return Fit(labels, theta, vcov, df, family, n, naive, -2.0 * ll, ll, 1.0, extra)


# -- ordinal -----------------------------------------------------------------------------
def _ordinal_step(x: list[str], k: int, theta: np.ndarray) -> Step:
    """Cumulative logit: P(y <= j) = logistic(zeta_j - eta)."""
    cuts, beta = theta[: k - 1], theta[k - 1 :]
    zeta = f"array({', '.join(num(c) for c in cuts)})"
    cdf = lambda position: f"1D / (1D + exp(eta - element_at({zeta}, CAST({position} AS INT))))"
    pre = [
        {"eta": linear(x, beta)},
        # upper and lower end of the class on the probability scale
        {"fu": f"CASE WHEN y = {k - 1} THEN 1D ELSE {cdf('y + 1')} END",
         "fl": f"CASE WHEN y = 0 THEN 0D ELSE {cdf('y')} END"},
        {"pr": "fu - fl", "du": "fu * (1D - fu)", "dl": "fl * (1D - fl)"},
        {"a": "du / pr", "b": "dl / pr", "gu": "du * (1D - 2D * fu) / pr", "gl": "dl * (1D - 2D * fl) / pr"},
    ]
    values, blocks, score = {"one": "1D"}, [], []
    for j in range(k - 1):
        pick = lambda own, below: f"w * (CASE WHEN y = {j} THEN {own} WHEN y = {j + 1} THEN {below} ELSE 0D END)"
        score.append(pick("a", "-b"))
        # minus second derivatives
        values[f"d{j}"] = pick("a * a - gu", "gl + b * b")
        blocks.append(Block(j, j, f"d{j}", ["one"], ["one"]))
        if j + 1 < k - 1:
            values[f"o{j}"] = f"CASE WHEN y = {j + 1} THEN -w * a * b ELSE 0D END"
            blocks.append(Block(j, j + 1, f"o{j}", ["one"], ["one"]))
        if x:
            values[f"m{j}"] = pick("gu - a * (a - b)", "b * (a - b) - gl")
            blocks.append(Block(j, k - 1, f"m{j}", ["one"], x))
    values["e"] = "w * ((a - b) * (a - b) - gu + gl)"
    values["s"] = "-w * (a - b)"
    score += [f"s * {c}" for c in x]
    if x:
        blocks.append(Block(k - 1, k - 1, "e", x, x))
    return Step([*pre, values], score, blocks, "w * ln(pr)", {"n": "1"})


def ordinal(data: Design | DataFrame, y: str, items: Sequence, weights: str | None = None,
            levels: Mapping[str, Sequence] | None = None, y_levels: Sequence | None = None) -> Fit:
    """Proportional-odds model. Coefficients first, then the cut points ``a|b``."""
    frame = data.df if isinstance(data, Design) else data
    columns = expand(frame, items, False, levels)
    y_levels, code = _codes(frame, y, y_levels)
    k = len(y_levels)
    model = model_rows(data, code, columns, weights)
    model.rows = model.rows.persist()
    try:
        shares = model.rows.groupBy("y").agg(F.sum("w").alias("w")).collect()
        w = np.zeros(k)
        for r in shares:
            w[int(r.y)] = r.w
        cum = np.cumsum(w)[:-1] / w.sum()
        start = np.concatenate([np.log(cum / (1 - cum)), np.zeros(len(columns))])
        build = lambda theta: _ordinal_step(model.x, k, theta)
        theta, score, info, ll, extra = newton(model, build, start)
        names = [f"{a}|{b}" for a, b in zip(y_levels, y_levels[1:])]
        fit = _finish(model, build, theta, info, [*names, *model.labels], "ordinal",
                      int(extra["n"]), ll, {"score": score})
    finally:
        model.rows.unpersist()
    order = [*range(k - 1, len(theta)), *range(k - 1)]
    fit.terms = [fit.terms[i] for i in order]
    fit.coef = fit.coef[order]
    fit.vcov, fit.naive = fit.vcov[np.ix_(order, order)], fit.naive[np.ix_(order, order)]
    fit.columns = columns
    fit.extra.update(levels=y_levels, n_cut=k - 1)
    return fit


# -- multinomial ---------------------------------------------------------------------------
def _multinomial_step(x: list[str], k: int, theta: np.ndarray) -> Step:
    p, others = len(x), range(1, k)
    links = {f"l{c}": linear(x, theta[(c - 1) * p : c * p]) for c in others}
    expo = {f"q{c}": f"exp(l{c} - top)" for c in others}
    probs = {f"p{c}": f"q{c} / total" for c in others}
    own = " ".join(f"WHEN y = {c} THEN l{c}" for c in others)
    values, blocks, score = {}, [], []
    for c in others:
        values[f"r{c}"] = f"w * ((CASE WHEN y = {c} THEN 1D ELSE 0D END) - p{c})"
        score += [f"r{c} * {j}" for j in x]
        for d in range(c, k):
            values[f"v{c}_{d}"] = f"w * ({f'p{c}' if c == d else '0D'} - p{c} * p{d})"
            blocks.append(Block((c - 1) * p, (d - 1) * p, f"v{c}_{d}", x, x))
    pre = [links, {"top": f"greatest(0D, {', '.join(links)})"}, expo,
           {"total": " + ".join(["exp(-top)", *expo])}, probs, values]
    return Step(pre, score, blocks, f"w * ((CASE {own} ELSE 0D END) - top - ln(total))", {"n": "1"})


def multinomial(data: Design | DataFrame, y: str, items: Sequence, weights: str | None = None,
                levels: Mapping[str, Sequence] | None = None, y_levels: Sequence | None = None,
                start: np.ndarray | None = None) -> Fit:
    """Multinomial logit against the first level; terms are named ``term:<category number>``."""
    frame = data.df if isinstance(data, Design) else data
    columns = expand(frame, items, True, levels)
    y_levels, code = _codes(frame, y, y_levels)
    k, p = len(y_levels), len(columns)
    model = model_rows(data, code, columns, weights)
    model.rows = model.rows.persist()
    try:
        build = lambda theta: _multinomial_step(model.x, k, theta)
        begin = np.zeros((k - 1) * p) if start is None else start
        theta, score, info, ll, extra = newton(model, build, begin)
        labels = [f"{t}:{c}" for c in range(1, k) for t in model.labels]
        fit = _finish(model, build, theta, info, labels, "multinomial", int(extra["n"]), ll,
                      {"score": score, "levels": y_levels, "p": p})
    finally:
        model.rows.unpersist()
    fit.columns = columns
    return fit


def multinomial_replicates(rep, y: str, items: Sequence, levels=None, y_levels=None,
                           tol: float = 1e-8, max_iter: int = 30) -> tuple[Fit, DataFrame]:
    """Refit the model under every bootstrap replicate; all replicates share each scan.

    Equal rows of a PSU are added up first. What is left carries the draw counts of its PSU,
    one byte per replicate. A task sums score and information of every replicate over its rows,
    and Spark adds the tasks up.
    """
    design = rep.design
    fit = multinomial(design, y, items, levels=levels, y_levels=y_levels)
    k, p, reps = len(fit.extra["levels"]), fit.extra["p"], rep.replicates
    q = (k - 1) * p
    _, code = _codes(design.df, y, fit.extra["levels"])
    model = model_rows(design, code, fit.columns)
    none = F.lit(bytes(reps))
    multiples = rep._numbered().join(rep.draws(), [STR, "rn"], "left").join(design.strata(), STR).select(
        STR, PSU, F.sqrt(1 - F.col("f_h")).alias("lam"), F.coalesce("times", none).alias("times"))
    summed = model.rows.groupBy(STR, PSU, "y", *model.x).agg(F.sum("w").alias("w"))
    rows = summed.join(multiples, [STR, PSU]).select("w", "y", "lam", "times", *model.x).persist()
    x_names, step = model.x, max(1, CACHED // reps)

    def partial_at(betas):
        slopes = betas.reshape(reps, k - 1, p).transpose(1, 0, 2)  # one (replicates x terms) table per category

        def add(score, info, x, code_, w):
            links = [x @ slope.T for slope in slopes]
            top = np.maximum(np.maximum.reduce(links), 0.0)
            e = [np.exp(link - top) for link in links]
            total = sum(e, np.exp(-top))
            prob = [c / total for c in e]
            square = np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
            for a in range(k - 1):
                score[:, a] += (((code_ == a + 1)[:, None] - prob[a]) * w).T @ x
                each = w * prob[a]
                for b in range(a, k - 1):
                    info[:, a, b] += ((each * ((a == b) - prob[b])).T @ square).reshape(reps, p, p)

        def partial(batches):
            score, info = np.zeros((reps, k - 1, p)), np.zeros((reps, k - 1, k - 1, p, p))
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    lam = part["lam"].to_numpy()[:, None]
                    w = part["w"].to_numpy()[:, None] * (1 - lam + lam * draw_counts(part["times"], reps))
                    add(score, info, part[x_names].to_numpy(dtype=float), part["y"].to_numpy().astype(int), w)
            for a in range(k - 1):
                for b in range(a + 1, k - 1):
                    info[:, b, a] = info[:, a, b].transpose(0, 2, 1)
            info = info.transpose(0, 1, 3, 2, 4)
            yield pd.DataFrame({
                "rep": np.repeat(np.arange(reps), q * (q + 1)),
                "pos": np.tile(np.arange(q * (q + 1)), reps),
                "value": np.concatenate([score.reshape(reps, q), info.reshape(reps, q * q)], 1).ravel(),
            })
        return partial

    betas = np.tile(fit.coef, (reps, 1))
    try:
        for _ in range(max_iter):
            parts = rows.mapInPandas(partial_at(betas.copy()), "rep int, pos int, value double")
            total = parts.groupBy("rep", "pos").agg(F.sum("value").alias("value")).toPandas()
            flat = total.sort_values(["rep", "pos"])["value"].to_numpy().reshape(reps, q * (q + 1))
            moves = np.stack([np.linalg.solve(f[q:].reshape(q, q), f[:q]) for f in flat])
            betas = betas + moves
            if np.max(np.abs(moves) / (1 + np.abs(betas))) < tol:
                break
        else:
            raise ArithmeticError(f"a replicate fit has not converged in {max_iter} steps")
    finally:
        rows.unpersist()
    scale = rep.scheme()["scale"]
    values = [(str(r + 1), t, float(betas[r, j]), 1, float(scale))
              for r in range(reps) for j, t in enumerate(fit.terms)]
    table = design.df.sparkSession.createDataFrame(
        values, "rep string, term string, value double, mult bigint, rscale double")
    return fit, table


# -- negative binomial -----------------------------------------------------------------------
def _negbin_step(x: list[str], theta: np.ndarray) -> Step:
    """Parameters: coefficients and log(size). The cost of a row does not depend on its count."""
    p, s = len(x), num(np.exp(theta[-1]))
    above = lambda f: f"{f(f'y + {s}')} - {f(s)}"  # between the functions at y + s and at s
    pre = [
        {"mu": f"exp({linear(x, theta[:-1])})", "g0": above(lgamma_sql), "g1": above(digamma_sql),
         "g2": f"-({above(trigamma_sql)})"},
        {"mix": f"mu + {s}"},
        {"d1": f"g1 + ln({s}) + 1D - ln(mix) - (y + {s}) / mix",
         "d2": f"-g2 + 1D / {s} - 1D / mix - (mu - y) / (mix * mix)"},
        {"one": "1D", "r": f"w * {s} * (y - mu) / mix", "v": f"w * mu * {s} * ({s} + y) / (mix * mix)",
         "c": f"-w * {s} * (y - mu) * mu / (mix * mix)", "t": f"-w * ({s} * {s} * d2 + {s} * d1)"},
    ]
    score = [f"r * {c}" for c in x] + [f"w * {s} * d1"]
    blocks = [Block(0, 0, "v", x, x), Block(0, p, "c", x, ["one"]), Block(p, p, "t", ["one"], ["one"])]
    ll = f"w * (g0 + {s} * ln({s}) + y * ln(mu) - (y + {s}) * ln(mix))"
    return Step(pre, score, blocks, ll, {"n": "1"})


def negbin(data: Design | DataFrame, y: str, items: Sequence, weights: str | None = None,
           levels: Mapping[str, Sequence] | None = None) -> Fit:
    """Negative-binomial counts; the size parameter is fitted jointly.

    ``extra`` holds theta and its error; the vcov covers the coefficients and log(theta).
    """
    frame = data.df if isinstance(data, Design) else data
    begin = glm(data, y, items, "poisson", weights, True, levels)
    columns = begin.columns
    model = model_rows(data, col(y).cast("double"), columns, weights)
    model.rows = model.rows.persist()
    try:
        m = model.rows.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"),
                           F.var_samp("y").alias("v")).first()
        size = m.m**2 / max(m.v - m.m, 0.05 * m.m)
        build = lambda theta: _negbin_step(model.x, theta)
        theta, score, info, ll, extra = newton(model, build, np.append(begin.coef, np.log(size)))
        ll -= float(model.rows.selectExpr(f"{LOG_FACTORIAL} AS f").first().f)
        fit = _finish(model, build, theta, info, [*model.labels, "log(theta)"], "negbin",
                      int(extra["n"]), ll, {"score": score})
    finally:
        model.rows.unpersist()
    value = float(np.exp(theta[-1]))
    fit.df = dist.INF
    fit.columns = columns
    fit.extra.update(theta=value, se_theta=value * float(np.sqrt(fit.vcov[-1, -1])))
    return fit
