"""Replicate weights as one vector per PSU, and refits of any estimator under all replicates at once.

A bootstrap replicate deals the n_h draws of a stratum to its PSUs. Here the draws are split down a binary tree of
the PSU numbers: at each node a binomial variate, seeded by the node, says how many go left. Any task can thus work out
the multiplicities of its own PSUs in every replicate, and no table of PSUs by replicates is made or moved. What
leaves a task are sums over its PSUs, one vector of the R replicates for each key; the shuffled rows do not grow with R.
"""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from hashlib import blake2b
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from designstats.functions.columns import col
from designstats.operators.design import PSU, STR
from designstats.operators.fitting import Fit, model_rows
from designstats.operators.frame import null_safe_join
from designstats.operators.glm import glm
from designstats.session import checkpoint

#: Row weights (rows x replicates) worked out at once, and keys whose sums a task holds before it passes them on.
SLICE, HELD = 1 << 21, 1024
#: Row weights that an ordinal step holds at once, so that its passes over them stay near the processor.
CACHED = 1 << 16
#: Different (y, x) up to which half-sample refits work from the totals of these.
PATTERNS = 64


def split_draws(seed: int, stratum: str, size: int, reps: int, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted PSU (numbers 0 .. size - 1, ascending) is drawn in each replicate: one row per PSU."""
    out = np.zeros((len(wanted), reps), dtype=np.int32)
    todo = [(0, size, 0, len(wanted), np.full(reps, size, dtype=np.int64))]
    while todo:
        lo, hi, a, b, drawn = todo.pop()
        if a == b:
            continue
        if hi - lo == 1:
            out[a:b] = drawn
            continue
        mid = (lo + hi) // 2
        key = int.from_bytes(blake2b(f"{seed}|{stratum}|{lo}|{hi}".encode(), digest_size=16).digest(), "little")
        left = np.random.Generator(np.random.Philox(key=key)).binomial(drawn, (mid - lo) / (hi - lo))
        cut = a + int(np.searchsorted(wanted[a:b], mid))
        todo += [(lo, mid, a, cut, left), (mid, hi, cut, b, drawn - left)]
    return out


def half_signs(pair: np.ndarray, sign: np.ndarray, reps: int) -> np.ndarray:
    """+1 where the PSU's half is doubled in the replicate, else -1 (rows of a Hadamard matrix)."""
    odd = np.bitwise_count(pair[:, None] & np.arange(reps)[None, :]) % 2
    return sign[:, None] * (1 - 2 * odd.astype(np.float64))


_PLACE = ["__str_text", "__number", "__size", "__share", "__sign"]


def placed_psus(rep) -> DataFrame:
    """What a task needs to know of a PSU to work out its weights in every replicate."""
    if rep.kind == "bootstrap":
        table = rep._numbered().join(rep.design.strata(), STR)
        return table.select(STR, PSU, F.col(STR).cast("string").alias("__str_text"), (F.col("rn") - 1).cast("long").alias("__number"),
                            F.col("n_h").cast("long").alias("__size"), F.sqrt(1 - F.col("f_h")).alias("__share"), F.lit(0.0).alias("__sign"))
    if rep.kind in ("BRR", "Fay"):
        return rep.pairs().select(STR, PSU, F.lit("").alias("__str_text"), F.col("__g").cast("long").alias("__number"),
                                  F.lit(0).cast("long").alias("__size"), F.lit(1.0 - rep.rho).alias("__share"), F.col("__sign"))
    raise ValueError(f"{rep.kind} has a replicate for every PSU; its totals are algebra, see RepDesign.with_replicates")


def factors(rep_kind: str, seed: int, reps: int, place: pd.DataFrame) -> np.ndarray:
    """The factor of a row's weight in every replicate, one row per row of place."""
    share = place["__share"].to_numpy()[:, None]
    number = place["__number"].to_numpy()
    if rep_kind != "bootstrap":
        return 1.0 + share * half_signs(number, place["__sign"].to_numpy(), reps)
    drawn = np.zeros((len(place), reps))
    for (stratum, size), at in place.groupby(["__str_text", "__size"], dropna=False).indices.items():
        own, back = np.unique(number[at], return_inverse=True)
        drawn[at] = split_draws(seed, stratum, int(size), reps, own)[back]
    return 1.0 - share + share * drawn


def in_order(rows: DataFrame) -> DataFrame:
    """Neighbouring PSUs share most of the tree, so they go to one task."""
    return rows.repartitionByRange("__str_text", "__number").sortWithinPartitions("__str_text", "__number")


def replicate_totals(rep, psu: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Replicate totals like RepDesign.totals (same columns), by vectors: for bootstrap, BRR and Fay.

    psu has one row for each stratum, PSU and key. NULL keys are a group of their own. Half-samples are as many as there
    are pairs, so theirs come from the transform of RepDesign.totals; only the bootstrap's vectors have a given length.
    """
    if rep.kind in ("BRR", "Fay"):
        return rep.totals(psu, keys, names).withColumn("rep", (F.col("rep").cast("long") + 1).cast("string"))
    scheme, keys, names = rep.scheme(), list(keys), list(names)
    kind, seed, reps = rep.kind, rep.seed, scheme["reps"]
    step = max(1, SLICE // reps)
    rows = in_order(psu.select(STR, PSU, *keys, *names).join(placed_psus(rep), [STR, PSU]).select(*_PLACE, *keys, *names))
    vectors = StructType([*[rows.schema[k] for k in keys], *[StructField(t, ArrayType(DoubleType())) for t in names]])

    def packed(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, *[v.tolist() for v in sums]) for key, sums in held.items()], columns=[*keys, *names])

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                f = factors(kind, seed, reps, part)
                values = part[names].to_numpy(dtype=float)
                groups = part.groupby(keys, dropna=False).indices if keys else {(): np.arange(len(part))}
                for key, at in groups.items():
                    key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                    sums = values[at].T @ f[at]
                    held[key] = held[key] + sums if key in held else sums
                    if len(held) >= HELD:
                        yield packed(held)
                        held = {}
        if held:
            yield packed(held)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([tuple([*(pdf[k].iloc[0] for k in keys), *(np.sum(np.stack(pdf[t].to_numpy()), axis=0).tolist() for t in names)])], columns=[*keys, *names])

    sums = rows.mapInPandas(partial, vectors).groupBy(*keys).applyInPandas(summed, vectors)
    share = 1 - F.col("__share")
    known = psu.select(STR, PSU, *keys, *names).join(placed_psus(rep), [STR, PSU])
    ends = known.groupBy(*keys).agg(*[F.sum(t).alias(f"full_{t}") for t in names],
                                    *[F.sum(share * F.col(t)).alias(f"base_{t}") for t in names])
    joined = null_safe_join(sums, ends, keys) if keys else sums.crossJoin(F.broadcast(ends))  # one row each
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(reps)).alias("rep"), *names)).alias("v")
    out = joined.select(*keys, *[f"full_{t}" for t in names], *[f"base_{t}" for t in names], each)
    return out.select(F.col("v.rep").cast("string").alias("rep"), *keys, *[F.col(f"v.{t}").alias(t) for t in names],
                      F.lit(1).cast("long").alias("mult"), F.lit(scheme["scale"]).alias("rscale"),
                      *[f"full_{t}" for t in names], *[f"base_{t}" for t in names])


# -- refits ------------------------------------------------------------------------------------
#: moments(x (n, p), y (n), coefficients (R, q), weights (n, R)) -> score (R, q) and information (R, q, q).
Moments = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def glm_moments(family: str) -> Moments:
    """Linear, logit and log-linear models: the products of all replicates are two matrix products."""
    def moments(x, y, beta, w):
        link = x @ beta.T
        if family == "gaussian":
            mean, spread = link, np.ones_like(link)
        elif family == "binomial":
            mean = 1 / (1 + np.exp(-link))
            spread = mean * (1 - mean)
        else:
            mean = spread = np.exp(link)
        score = (w * (y[:, None] - mean)).T @ x
        square = np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
        return score, ((w * spread).T @ square).reshape(len(beta), x.shape[1], x.shape[1])

    return moments


def ordinal_moments(cuts: int) -> Moments:
    """Cumulative logit P(y <= c) = logistic(cut_c - x b); coefficients: cuts first. Expected information."""
    def add(score, info, xx, x, y, beta, w):
        odds, square = np.exp(x @ beta[:, cuts:].T), np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
        low, low_slope = 0.0, 0.0
        for c in range(cuts + 1):  # the probability of category c moves with the cuts c and c - 1 and with the slopes
            high = 1 / (1 + odds * np.exp(-beta[:, c])) if c < cuts else 1.0
            high_slope = high * (1 - high)
            gap = low_slope - high_slope
            each = w / np.maximum(high - low, 1e-300)
            own, side = each * (y == c)[:, None], each * gap
            if c < cuts:
                score[:, c] += (own * high_slope).sum(0)
                info[:, c, c] += (each * high_slope * high_slope).sum(0)
                info[:, c, cuts:] += (side * high_slope).T @ x
            if c:
                score[:, c - 1] -= (own * low_slope).sum(0)
                info[:, c - 1, c - 1] += (each * low_slope * low_slope).sum(0)
                info[:, c - 1, cuts:] -= (side * low_slope).T @ x
            if 0 < c < cuts:
                info[:, c - 1, c] -= (each * low_slope * high_slope).sum(0)
            score[:, cuts:] += (own * gap).T @ x
            xx += (side * gap).T @ square
            low, low_slope = high, high_slope

    def moments(x, y, beta, w):
        (reps, q), p = beta.shape, x.shape[1]
        score, info, xx = np.zeros((reps, q)), np.zeros((reps, q, q)), np.zeros((reps, p * p))
        step = max(1, CACHED // reps)
        for lo in range(0, len(x), step):
            part = slice(lo, lo + step)
            add(score, info, xx, x[part], y[part], beta, w[part])
        upper = np.triu(info, 1)
        info = info + upper.transpose(0, 2, 1)
        info[:, cuts:, cuts:] = xx.reshape(reps, p, p)
        return score, info

    return moments


def _value_table(totals: DataFrame, names: Sequence[str], terms: Sequence[str], solve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rep, term, value, mult, rscale from one row of totals for each replicate; solve: totals (n, names) -> values (n, terms)."""
    names, terms = list(names), list(terms)

    def solved(batches):
        for pdf in batches:
            if len(pdf):
                found = solve(pdf[names].to_numpy(dtype=float))
                yield pd.DataFrame({"rep": np.repeat((pdf["rep"].astype(np.int64) + 1).astype(str).to_numpy(), len(terms)), "term": terms * len(pdf),
                                    "value": found.ravel(), "mult": 1, "rscale": np.repeat(pdf["rscale"].to_numpy(), len(terms))})

    schema = "rep string, term string, value double, mult bigint, rscale double"
    return checkpoint(totals.select("rep", "rscale", *names).mapInPandas(solved, schema))


def _newton_steps(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, reps: int, tol: float, max_iter: int) -> np.ndarray:
    """Coefficients (reps, q) at which the scores are zero."""
    beta = np.tile(np.asarray(start, dtype=float), (reps, 1))
    for _ in range(max_iter):
        score, info = sums(beta)
        moves = np.linalg.solve(info, score[:, :, None])[:, :, 0]
        beta = beta + moves
        if not np.isfinite(beta).all():
            raise ArithmeticError("a replicate fit has diverged")
        if np.max(np.abs(moves) / (1 + np.abs(beta))) < tol:
            return beta
    raise ArithmeticError(f"a replicate fit has not converged in {max_iter} steps")


def refit_patterns(rep, rows: DataFrame, x: Sequence[str], patterns: Sequence, start: np.ndarray, terms: Sequence[str], moments: Moments,
                   tol: float, max_iter: int) -> DataFrame:
    """Half-sample refits of rows with few different (y, x): the weights of the patterns in every replicate are one
    transform, and each task then fits its own replicates from them."""
    table = np.array([tuple(p) for p in patterns], dtype=float)
    names = [f"w{k}" for k in range(len(table))]
    same = lambda p: reduce(and_, [F.col(c) == F.lit(float(v)) for c, v in zip(["y", *x], p)])
    psu = rows.groupBy(STR, PSU, F.lit("w").alias("k")).agg(*[F.sum(F.when(same(p), F.col("w")).otherwise(0.0)).alias(n) for n, p in zip(names, table)])

    def solve(weights):
        return _newton_steps(lambda beta: moments(table[:, 1:], table[:, 0], beta, weights.T), start, len(weights), tol, max_iter)

    return _value_table(rep.totals(psu, ["k"], names), names, terms, solve)


def refit_linear(rep, rows: DataFrame, x: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Half-sample refits of a linear model: its products are totals, so those of all replicates are one transform."""
    x = list(x)
    p = len(x)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = {f"a{i}_{j}": F.col(x[i]) * F.col(x[j]) for i, j in upper} | {f"b{i}": F.col(x[i]) * F.col("y") for i in range(p)}
    psu = rows.groupBy(STR, PSU, F.lit("w").alias("k")).agg(*[F.sum(F.col("w") * c).alias(n) for n, c in sums.items()])

    def solve(totals):
        left = np.zeros((len(totals), p, p))
        for k, (i, j) in enumerate(upper):
            left[:, i, j] = left[:, j, i] = totals[:, k]
        return np.linalg.solve(left, totals[:, len(upper):, None])[:, :, 0]

    return _value_table(rep.totals(psu, ["k"], list(sums)), list(sums), terms, solve)


def refit(rep, rows: DataFrame, x: Sequence[str], start: np.ndarray, terms: Sequence[str], moments: Moments,
          tol: float = 1e-8, max_iter: int = 50) -> DataFrame:
    """Refit an estimator under every replicate: rep, term, value, mult, rscale.

    rows: stratum, PSU, y, w and the columns x of complete cases. Equal rows of a PSU are added up first. All replicates start
    from the full fit and share each job; a replicate that does not converge raises. Half-samples are as many as there are
    pairs of PSUs: up to PATTERNS different (y, x) their fits need no more than the totals of these; with more, every row
    meets every replicate, which is rows x replicates by its nature.
    """
    scheme, x = rep.scheme(), list(x)
    if rep.kind in ("BRR", "Fay"):
        patterns = rows.select("y", *x).distinct().limit(PATTERNS + 1).collect()
        if len(patterns) <= PATTERNS:
            return refit_patterns(rep, rows, x, patterns, start, terms, moments, tol, max_iter)
    kind, seed, reps, q = rep.kind, rep.seed, scheme["reps"], len(start)
    step = max(1, SLICE // reps)
    summed = rows.groupBy(STR, PSU, "y", *x).agg(F.sum("w").alias("w"))
    ready = in_order(summed.join(placed_psus(rep), [STR, PSU]).select(*_PLACE, "y", "w", *x)).persist()

    def sums_at(beta):
        def partial(batches):
            score, info = np.zeros((reps, q)), np.zeros((reps, q, q))
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    w = part["w"].to_numpy()[:, None] * factors(kind, seed, reps, part)
                    s, h = moments(part[x].to_numpy(dtype=float), part["y"].to_numpy(dtype=float), beta, w)
                    score, info = score + s, info + h
            yield pd.DataFrame({"rep": np.arange(reps), "v": list(np.concatenate([score, info.reshape(reps, q * q)], axis=1))})

        return partial

    def added(pdf):
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    schema = "rep int, v array<double>"

    def total_at(beta):
        total = ready.mapInPandas(sums_at(beta.copy()), schema).groupBy("rep").applyInPandas(added, schema).toPandas()  # R rows
        flat = np.stack(total.sort_values("rep")["v"].to_numpy())
        return flat[:, :q], flat[:, q:].reshape(reps, q, q)

    try:
        beta = _newton_steps(total_at, start, reps, tol, max_iter)
    finally:
        ready.unpersist()
    values = [(str(r + 1), t, float(beta[r, j]), 1, float(scheme["scale"])) for r in range(reps) for j, t in enumerate(terms)]
    return rep.design.df.sparkSession.createDataFrame(values, "rep string, term string, value double, mult bigint, rscale double")


def replicate_glm(rep, y: str, items: Sequence, family: str = "gaussian", levels: Mapping[str, Sequence] | None = None) -> tuple[Fit, DataFrame]:
    """A generalised linear model on the design and its coefficients under every replicate."""
    fit = glm(rep.design, y, items, family, levels=levels)
    model = model_rows(rep.design, col(y).cast("double"), fit.columns)
    if family == "gaussian" and rep.kind in ("BRR", "Fay"):
        return fit, refit_linear(rep, model.rows, model.x, fit.terms)
    return fit, refit(rep, model.rows, model.x, fit.coef, fit.terms, glm_moments(family))


def replicate_ordinal(rep, y: str, items: Sequence, y_levels: Sequence, levels: Mapping[str, Sequence] | None = None) -> tuple[Fit, DataFrame]:
    """A cumulative logit model on the design and its coefficients (slopes, then cuts) under every replicate."""
    from designstats.operators.categorical import ordinal

    fit = ordinal(rep.design, y, items, levels=levels, y_levels=y_levels)
    code = F.lit(None).cast("int")
    for k, v in enumerate(y_levels):
        code = F.when(F.col(y) == v, k).otherwise(code)
    model = model_rows(rep.design, code.cast("double"), fit.columns)
    cuts = len(y_levels) - 1
    slopes = len(fit.terms) - cuts
    order = [*range(slopes, len(fit.terms)), *range(slopes)]
    terms = [fit.terms[k] for k in order]
    return fit, refit(rep, model.rows, model.x, fit.coef[order], terms, ordinal_moments(cuts))


def replicate_table(fit: Fit, values: DataFrame) -> DataFrame:
    """term, estimate of the full fit, and the replicate error around the mean of the replicates."""
    spark = values.sparkSession
    mean = values.groupBy("term").agg((F.sum(F.col("mult") * F.col("value")) / F.sum("mult")).alias("m"))
    spread = values.join(F.broadcast(mean), "term").groupBy("term").agg(
        F.sqrt(F.sum(F.col("mult") * F.col("rscale") * (F.col("value") - F.col("m")) ** 2)).alias("std_error"))
    own = spark.createDataFrame([(t, float(b)) for t, b in zip(fit.terms, fit.coef)], "term string, estimate double")
    return own.join(spread, "term")
