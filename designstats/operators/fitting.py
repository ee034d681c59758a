"""Shared machinery of all model fits.

A fit is a short driver loop around Spark aggregates: every step sends the current
coefficients into the plan as literals and gets back the summed score and information,
whose size depends on the number of coefficients only.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from designstats.functions import dist
from designstats.operators.design import PSU, STR, WT, Design

JVM_SUMS = 160


def lgamma_sql(x: str) -> str:
    """Log gamma of a positive expression: Stirling's series ten places on, so the cost does not grow with x."""
    z, shift = f"(({x}) + 10D)", " * ".join(f"(({x}) + {k}D)" for k in range(10))
    return (f"(({z} - 0.5D) * ln({z}) - {z} + 0.918938533204672742D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3))"
            f" + 1D / (1260D * pow({z}, 5)) - 1D / (1680D * pow({z}, 7)) - ln({shift}))")


def digamma_sql(x: str) -> str:
    z, shift = f"(({x}) + 10D)", " + ".join(f"1D / (({x}) + {k}D)" for k in range(10))
    return (f"(ln({z}) - 0.5D / {z} - 1D / (12D * pow({z}, 2)) + 1D / (120D * pow({z}, 4)) - 1D / (252D * pow({z}, 6))"
            f" - ({shift}))")


def trigamma_sql(x: str) -> str:
    z, shift = f"(({x}) + 10D)", " + ".join(f"1D / pow(({x}) + {k}D, 2)" for k in range(10))
    return (f"(1D / {z} + 0.5D / pow({z}, 2) + 1D / (6D * pow({z}, 3)) - 1D / (30D * pow({z}, 5)) + 1D / (42D * pow({z}, 7))"
            f" + ({shift}))")


@dataclass
class Block:
    """Information block: sum of v * a_i * b_j over rows, placed at (row, col)."""

    row: int
    col: int
    v: str
    a: Sequence[str]
    b: Sequence[str]


@dataclass
class Step:
    """What a model needs per row at given parameters, as SQL expressions.

    Text keeps the driver cheap: a fit with p coefficients sums p * p products per step, and a
    line of SQL per product is one call where Column arithmetic would be a dozen.
    """

    pre: list[dict[str, str]]
    score: list[str]
    blocks: list[Block]
    loglik: str
    extra: dict[str, str] = field(default_factory=dict)


def num(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def linear(names: Sequence[str], coef: Sequence[float]) -> str:
    return " + ".join(["0D", *[f"{n} * {num(b)}" for n, b in zip(names, coef)]])


@dataclass
class ModelRows:
    """Complete rows of a model: columns x0.., y, w and, with a design, its stratum and PSU."""

    rows: DataFrame
    labels: list[str]
    design: Design | None

    @property
    def x(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.labels))]


def model_rows(data: Design | DataFrame, y: Column | None, columns: list[tuple[str, Column]],
               weights: str | None = None) -> ModelRows:
    """Select the model columns; rows with a missing value leave as a domain.

    With a design the PSU counts come from the full design, so leaving rows out of the scan
    does not change the variance formula.
    """
    if isinstance(data, Design):
        base, keys, w = data.domain_rows(), [STR, PSU], F.col(WT)
    else:
        base, keys = data, []
        w = F.lit(1.0) if weights is None else F.col(weights).cast("double")
    picked = [c.alias(f"x{i}") for i, (_, c) in enumerate(columns)]
    if y is not None:
        picked.append(y.alias("y"))
    rows = base.select(*keys, w.alias("w"), *picked).dropna()
    return ModelRows(rows, [n for n, _ in columns], data if isinstance(data, Design) else None)


def project(rows: DataFrame, pre: list[dict[str, str]]) -> DataFrame:
    for layer in pre:
        rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items()])
    return rows


def step_sums(rows: DataFrame, step: Step, q: int) -> tuple[np.ndarray, np.ndarray, float, dict]:
    """Summed score (q), information (q x q), log-likelihood and extras at the step's values."""
    ready = project(rows, step.pre)
    plan = []  # (row, col, mirrored, block, i, j)
    for block in step.blocks:
        same = tuple(block.a) == tuple(block.b)
        for i in range(len(block.a)):
            for j in range(i if same else 0, len(block.b)):
                plan.append((block, i, j, same))
    heads = {**{f"s{k}": c for k, c in enumerate(step.score)}, "ll": step.loglik,
             **{f"e_{k}": c for k, c in step.extra.items()}}
    if len(plan) + len(heads) <= JVM_SUMS:
        exprs = [f"sum({c}) AS {k}" for k, c in heads.items()]
        exprs += [f"sum({b.v} * {b.a[i]} * {b.b[j]}) AS h{n}" for n, (b, i, j, _) in enumerate(plan)]
        row = ready.selectExpr(*exprs).first().asDict()
        values = [row[f"h{n}"] for n in range(len(plan))]
    else:
        row, values = _wide_sums(ready, heads, step.blocks, plan)
    info = np.zeros((q, q))
    for (block, i, j, same), value in zip(plan, values):
        r, c = block.row + i, block.col + j
        info[r, c] = info[c, r] = value
        if same and block.row != block.col:
            r, c = block.row + j, block.col + i
            info[r, c] = info[c, r] = value
    score = np.array([row[f"s{k}"] for k in range(len(step.score))], dtype=float)
    return score, info, float(row["ll"]), {k: row[f"e_{k}"] for k in step.extra}


def _wide_sums(ready: DataFrame, heads: dict[str, str], blocks: list[Block], plan) -> tuple[dict, list]:
    """Many products: matrix products per Arrow batch, one short vector per task, summed by Spark."""
    needed = list(dict.fromkeys(n for b in blocks for n in (b.v, *b.a, *b.b)))
    narrow = ready.selectExpr(*[f"CAST({c} AS DOUBLE) AS {k}" for k, c in heads.items()], *needed)
    head_names = list(heads)
    shapes = [(b.v, tuple(b.a), tuple(b.b)) for b in blocks]

    def partial(batches):
        head = np.zeros(len(head_names))
        grams = [np.zeros((len(a), len(b))) for _, a, b in shapes]
        for pdf in batches:
            head += pdf[head_names].to_numpy(dtype=float).sum(0)
            for g, (v, a, b) in zip(grams, shapes):
                left = pdf[list(a)].to_numpy(dtype=float) * pdf[v].to_numpy(dtype=float)[:, None]
                g += left.T @ pdf[list(b)].to_numpy(dtype=float)
        flat = np.concatenate([head, *[g.ravel() for g in grams]])
        yield pd.DataFrame({"pos": np.arange(len(flat)), "value": flat})

    parts = narrow.mapInPandas(partial, "pos int, value double")
    total = {r.pos: r.value for r in parts.groupBy("pos").agg(F.sum("value").alias("value")).collect()}
    flat = np.array([total[i] for i in range(len(total))])
    row = dict(zip(head_names, flat))
    offsets, at = {}, len(head_names)
    for b in blocks:
        offsets[id(b)] = at
        at += len(b.a) * len(b.b)
    return row, [flat[offsets[id(b)] + i * len(b.b) + j] for b, i, j, _ in plan]


def newton(model: ModelRows, build: Callable[[np.ndarray], Step], start: np.ndarray,
           tol: float = 1e-9, max_iter: int = 50):
    """Newton's method with step halving on the log-likelihood; returns theta and final sums.

    A fit that does not converge raises: neither a worse likelihood nor an unfinished theta is returned.
    """
    theta = np.array(start, dtype=float)
    score, info, ll, extra = step_sums(model.rows, build(theta), len(theta))
    for _ in range(max_iter):
        move = np.linalg.solve(info, score)
        size = 1.0
        while True:
            trial = theta + size * move
            found = step_sums(model.rows, build(trial), len(theta))
            if np.isfinite(found[2]) and found[2] >= ll - 1e-9 * (1 + abs(ll)):
                break
            size /= 2
            if size < 1e-8:
                raise ArithmeticError("no step improves the likelihood")
        theta, (score, info, ll, extra) = trial, found
        if np.max(np.abs(size * move) / (1 + np.abs(theta))) < tol:
            break
    else:
        raise ArithmeticError(f"the fit has not converged in {max_iter} steps")
    return theta, score, info, ll, extra


def total_covariance(design: Design, psu: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Design covariance of a vector of totals (one row per stratum and PSU), for every lonely policy.

    Within a stratum it is the scaled sum of squares less that of the stratum total. A single PSU
    adds nothing (remove, average), its own square (adjust), or is an error (fail).
    """
    strata = design.strata()
    counts = strata.agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("n_h") == 1).cast("int")).alias("single")).first()
    if design.lonely == "fail" and counts.single:
        raise ValueError("stratum with a single PSU")
    n, f = F.col("n_h"), F.col("f_h")
    alone = 1 - f if design.lonely == "adjust" else F.lit(0.0)
    scale = F.when(n > 1, (1 - f) * n / (n - 1)).otherwise(alone)
    centre = F.when(n > 1, scale / n).otherwise(0.0)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    if len(names) + len(pairs) <= JVM_SUMS:  # one pass over the PSU totals
        products = {f"__q{k}": f"{names[i]} * {names[j]}" for k, (i, j) in enumerate(pairs)}
        sums = [F.sum(t).alias(t) for t in names] + [F.expr(f"sum({e}) AS {q}") for q, e in products.items()]
        by_stratum = psu.groupBy(STR).agg(*sums).join(strata, STR).withColumns({"__scale": scale, "__centre": centre})
        row = by_stratum.selectExpr(*[f"sum(__scale * {q}) - sum(__centre * {e}) AS {q}" for q, e in products.items()]).first()
        out = np.zeros((len(names), len(names)))
        for value, (i, j) in zip(row, pairs):
            out[i, j] = out[j, i] = value
    else:
        keyed = psu.join(strata, STR).withColumn("c", scale)
        by_stratum = psu.groupBy(STR).agg(*[F.sum(t).alias(t) for t in names]).join(strata, STR)
        out = gram(keyed, names, "c") - gram(by_stratum.withColumn("c", centre), names, "c")
    return out * counts["all"] / (counts["all"] - counts.single) if design.lonely == "average" and counts.single else out


def gram(df: DataFrame, names: Sequence[str], v: str) -> np.ndarray:
    """sum v x x' of many columns."""
    block = Block(0, 0, v, list(names), list(names))
    step = Step([], [], [block], "0D")
    return step_sums(df, step, len(names))[1]


def influence_covariance(model: ModelRows, step: Step) -> np.ndarray:
    """Design covariance of the summed scores."""
    ready = project(model.rows, step.pre)
    names = [f"u{k}" for k in range(len(step.score))]
    psu = ready.groupBy(STR, PSU).agg(*[F.expr(f"sum({c}) AS {n}") for n, c in zip(names, step.score)])
    return total_covariance(model.design, psu, names)


@dataclass
class Fit:
    """A fitted model; everything in it has the size of the coefficient vector."""

    terms: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    df: float
    family: str
    n: int
    naive: np.ndarray
    deviance: float = float("nan")
    loglik: float = float("nan")
    dispersion: float = 1.0
    extra: dict = field(default_factory=dict)
    columns: list = field(default_factory=list)

    def __getitem__(self, term: str) -> float:
        return float(self.coef[self.terms.index(term)])

    def se(self, term: str | None = None):
        errors = np.sqrt(np.diag(self.vcov))
        return errors if term is None else float(errors[self.terms.index(term)])

    def rows(self) -> list[tuple]:
        out = []
        for t, b, s in zip(self.terms, self.coef, self.se()):
            stat = b / s if s > 0 else float("nan")
            p = 2 * dist.t_sf(abs(stat), self.df) if s > 0 else float("nan")
            out.append((t, float(b), float(s), float(stat), float(p)))
        return out

    def tidy(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.rows(),
            "term string, estimate double, std_error double, statistic double, p_value double",
        )

    def confint(self, spark, level: float = 0.95, df: float | None = None) -> DataFrame:
        q = dist.t_ppf(0.5 + level / 2, self.df if df is None else df)
        rows = [(t, float(b), float(b - q * s), float(b + q * s))
                for t, b, s in zip(self.terms, self.coef, self.se())]
        return spark.createDataFrame(rows, "term string, estimate double, low double, upp double")

    def vcov_table(self, spark) -> DataFrame:
        rows = [(a, b, float(self.vcov[i, j])) for i, a in enumerate(self.terms)
                for j, b in enumerate(self.terms)]
        return spark.createDataFrame(rows, "a string, b string, cov double")
