"""Missing data: summaries, chained imputation (predictive mean matching, categories), pooling."""

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from designstats.functions.columns import seeded_uniform
from designstats.operators.frame import running_count
from designstats.session import checkpoint


def case_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows with and without a missing value."""
    names = df.columns if names is None else names
    any_null = F.lit(False)
    for c in names:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.sum(any_null.cast("long")).alias("n_miss"), F.sum((~any_null).cast("long")).alias("n_complete"))


def missing_summary(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """variable, n_miss, pct_miss for every column, one pass, most missing first."""
    names = df.columns if names is None else list(names)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("n_miss")) for c in names])
    long = one.select("__n", F.inline(cells))
    pct = (100.0 * F.col("n_miss") / F.col("__n")).alias("pct_miss")
    return long.select("variable", "n_miss", pct).orderBy(F.desc("n_miss"), "variable")


def impute(df: DataFrame, key: str, targets: Sequence[str], predictors: Sequence[str], m: int = 20,
           sweeps: int = 5, seed: int = 1234, donors: int = 5, categories: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Chained equations with predictive mean matching; m stacked copies in ``__imp``.

    For every incomplete column a linear model is fitted per copy (one grouped aggregate, p x p
    sums to the driver), a coefficient draw predicts the missing rows, and each takes the value
    of one of the ``donors`` observed rows with the nearest prediction. Donors are numbered in
    the order of their prediction; a missing row looks up the numbers around its own place by
    an equi-join. With one incomplete column all copies share the same donor numbering.

    ``categories`` names the categorical columns and their levels. As predictors they enter by indicators of all
    levels but the first. As targets they get a logit or polytomous model: coefficients are drawn from their normal
    approximation, and each missing row takes the level at which the running sum of its probabilities passes a uniform
    number hashed from (seed, sweep, target, copy, key). An observed value outside the levels raises.

    Rows whose predictors are themselves NULL in part are predicted by a model of those they have,
    one for each such pattern; a row to fill that has no predictor at all raises.
    """
    rng = np.random.default_rng(seed)
    targets, predictors = list(targets), list(predictors)
    chained = len(targets) > 1
    rounds = sweeps if chained else 1
    full = [*dict.fromkeys([*predictors, *targets])]
    categories = {c: list(v) for c, v in (categories or {}).items()}
    _known_levels(df, {c: v for c, v in categories.items() if c in full})
    patterns = {t: _null_patterns(df, t, [c for c in full if c != t], targets, categories) for t in targets}
    copies = df.withColumns({f"__miss_{t}": F.col(t).isNull() for t in targets})
    copies = copies.withColumn("__imp", F.explode(F.sequence(F.lit(1), F.lit(m))))
    if chained:  # start from the observed mean or the most frequent level
        first = {t: F.mode(t, True) if t in categories else F.avg(t) for t in targets}
        start = df.agg(F.struct(*[v.alias(t) for t, v in first.items()]).alias("s")).scalar()
        copies = copies.withColumn("__s", start)
        own = lambda t: F.col(t) if t in categories else F.col(t).cast("double")
        copies = copies.withColumns({t: F.coalesce(own(t), F.col(f"__s.{t}")) for t in targets}).drop("__s")
    for sweep in range(1, rounds + 1):
        for target in targets:
            x = [c for c in full if c != target]
            for lost in patterns[target]:
                if target in categories:
                    copies = _impute_category(copies, key, target, x, lost, m, f"{seed}|{sweep}|{target}", categories, shared=not chained)
                else:
                    copies = _impute_one(copies, key, target, x, lost, m, rng, donors, not chained, categories)
            if chained:
                copies = checkpoint(copies)
    return copies.drop(*[f"__miss_{t}" for t in targets])


def _gone(c: str, categories=()):
    """As dropna sees it: NULL or NaN."""
    return F.col(c).isNull() if c in categories else F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def _known_levels(df, categories) -> None:
    if not categories:
        return
    odd = df.agg(*[F.coalesce(F.sum((F.col(c).isNotNull() & ~F.col(c).isin(v)).cast("long")), F.lit(0)).alias(c) for c, v in categories.items()]).first()
    if bad := [c for c in categories if odd[c]]:
        raise ValueError(f"values outside the levels: {', '.join(bad)}")


def _design(x: Sequence[str], categories) -> list:
    """Model columns: the constant, numbers, and indicators of all levels but the first."""
    out = [F.lit(1.0)]
    for c in x:
        out += [(F.col(c) == v).cast("double") for v in categories[c][1:]] if c in categories else [F.col(c).cast("double")]
    return out


def _rows_to_fill(x, lost, target, categories):
    """Missing in the target, with NULL in exactly the lost predictors."""
    mine = F.col(f"__miss_{target}")
    for c in x:
        gone = _gone(c, categories)
        mine = mine & F.coalesce(gone if c in lost else ~gone, F.lit(c in lost))
    return mine


def _null_patterns(df, target, x, targets, categories) -> list[list[str]]:
    """The sets of predictors that are NULL together in rows to fill, the fewest first; incomplete targets are chained, so they count as there."""
    given = [c for c in x if c not in targets]
    lost = F.filter(F.array(*[F.when(_gone(c, categories), F.lit(c)) for c in given]), lambda c: c.isNotNull()) if given else F.array().cast("array<string>")
    found = sorted((r["p"] for r in df.where(F.col(target).isNull()).select(lost.alias("p")).distinct().collect()), key=lambda p: (len(p), p))
    if x and any(len(p) == len(x) for p in found):
        raise ValueError(f"rows without {target} have no predictor either: {', '.join(x)} are NULL")
    return found or [[]]


def _impute_one(copies, key, target, x, lost, m, rng, donors, shared, categories):
    miss = F.col(f"__miss_{target}")
    mine = _rows_to_fill(x, lost, target, categories)
    x = [c for c in x if c not in lost]
    value = F.col(target).cast("double")
    columns = _design(x, categories)
    p = len(columns)
    observed = copies.where(~miss).dropna(subset=x)
    if shared:
        observed = observed.where("__imp = 1")
    sums = {"n": F.count(F.lit(1)), "yy": F.sum(value * value)}
    for i in range(p):
        sums[f"b{i}"] = F.sum(columns[i] * value)
        for j in range(i, p):
            sums[f"a{i}_{j}"] = F.sum(columns[i] * columns[j])
    stats = {r["__imp"]: r for r in observed.groupBy("__imp").agg(*[e.alias(n) for n, e in sums.items()]).collect()}
    hat, star = {}, {}
    for imp in range(1, m + 1):
        r = stats[1 if shared else imp]
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        inv = np.linalg.inv(a)
        b = np.array([r[f"b{i}"] for i in range(p)])
        beta = inv @ b
        rss = max(float(r["yy"] - b @ beta), 0.0)
        sigma = np.sqrt(rss / rng.chisquare(max(r["n"] - p, 1)))
        hat[imp] = beta
        star[imp] = beta + sigma * np.linalg.cholesky(inv) @ rng.standard_normal(p)

    def predicted(table):
        weights = F.element_at(
            F.array(*[F.array(*[F.lit(float(v)) for v in table[i]]) for i in range(1, m + 1)]), F.col("__imp"))
        out = F.lit(0.0)
        for i, c in enumerate(columns):
            out = out + c * F.element_at(weights, i + 1)
        return out

    by = [] if shared else ["__imp"]
    give = observed.select("__imp", F.col(key).alias("__key"), predicted(hat).alias("__p"),
                           value.alias("__v"), F.lit(1).alias("__donor"))
    take = copies.where(mine).select("__imp", F.col(key).alias("__key"), predicted(star).alias("__p"),
                                                      F.lit(None).cast("double").alias("__v"), F.lit(0).alias("__donor"))
    # one stable numbering serves both sides of the look-up below
    placed = checkpoint(running_count(give.unionByName(take), by, "__p", "__key", F.col("__donor") == 1, "__rank"))
    pool = placed.where("__donor = 1").select(*by, "__rank", F.col("__p").alias("__dp"), F.col("__v").alias("__dv"))
    seek = placed.where("__donor = 0").select(
        "__imp", "__key", "__p",
        F.explode(F.sequence(F.col("__rank") - (donors - 1), F.col("__rank") + donors)).alias("__rank"))
    near = seek.join(pool, [*by, "__rank"]).groupBy("__imp", "__key").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.abs(F.col("__dp") - F.col("__p")).alias("d"), "__rank", "__dv"))), 1, donors).alias("c"))
    pick = (F.floor(seeded_uniform(F.concat_ws("|", F.lit(target), F.col("__imp").cast("string"), F.col("__key").cast("string")), int(rng.integers(1 << 30)))
                    * F.size("c")) + 1).cast("int")
    chosen = near.select("__imp", F.col("__key").alias(key), F.element_at("c", pick)["__dv"].alias("__new"))
    # only the missing rows move; the observed ones stay where they are
    filled = copies.where(mine).join(chosen, ["__imp", key], "left").withColumn(target, F.col("__new")).drop("__new")
    return copies.where(~mine).withColumn(target, value).unionByName(filled)


def hashed_normals(text: str, n: int) -> np.ndarray:
    """Standard normals from md5 of the text and their number (Box-Muller), so that any engine can draw them again."""
    u = lambda k, part: (int(md5(f"{text}|{k}|{part}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
    return np.array([np.sqrt(-2 * np.log(u(k, 0))) * np.cos(2 * np.pi * u(k, 1)) for k in range(n)])


#: Spread of the prior that takes over where a level can be told by the predictors.
PRIOR_SD = 10.0


def polytomous_by_copy(rows: DataFrame, p: int, k: int, copies: Sequence[int], tol: float = 1e-9, max_iter: int = 60) -> dict:
    """Polytomous logit fits of all copies at once: copy -> (coefficients, information), class by class against the first.

    rows: __imp, y (0 .. k - 1) and x0 .. x(p-1). Every Newton step is one job that returns the sums of each copy; a step that
    lowers a copy's likelihood is halved. A copy whose likelihood has no maximum, because a level can be told by the
    predictors, is fitted again with a normal prior of standard deviation PRIOR_SD for each coefficient. A level that a copy
    has not seen raises.
    """
    seen = {(r["__imp"], r["y"]) for r in rows.select("__imp", "y").distinct().collect()}  # copies x levels at most
    if unseen := {(i, y) for i in copies for y in range(k)} - seen:
        raise ValueError(f"levels without an observed row (copy, level): {sorted(unseen)[:5]}")
    q, names = (k - 1) * p, [f"x{i}" for i in range(p)]

    def at(theta):
        def partial(batches):
            held: dict[int, np.ndarray] = {}
            for pdf in batches:
                for imp, own in pdf.groupby("__imp"):
                    x, y = own[names].to_numpy(dtype=float), own["y"].to_numpy().astype(int)
                    link = np.column_stack([np.zeros(len(x)), x @ theta[imp].reshape(k - 1, p).T])
                    top = link.max(axis=1, keepdims=True)
                    total = np.exp(link - top).sum(axis=1, keepdims=True)
                    prob = np.exp(link - top) / total
                    like = (link[np.arange(len(y)), y] - top[:, 0] - np.log(total[:, 0])).sum()
                    score = ((np.arange(1, k) == y[:, None]) - prob[:, 1:]).T @ x
                    info = np.zeros((q, q))
                    for c in range(1, k):
                        for d in range(1, k):
                            v = prob[:, c] * ((c == d) - prob[:, d])
                            info[(c - 1) * p:c * p, (d - 1) * p:d * p] = (x * v[:, None]).T @ x
                    sums = np.concatenate([[like], score.ravel(), info.ravel()])
                    held[imp] = held[imp] + sums if imp in held else sums
            for imp, sums in held.items():
                yield pd.DataFrame({"__imp": imp, "pos": np.arange(len(sums)), "value": sums})

        found = rows.mapInPandas(partial, "__imp int, pos int, value double").groupBy("__imp", "pos").agg(F.sum("value").alias("value")).toPandas()
        return {int(imp): own.sort_values("pos")["value"].to_numpy() for imp, own in found.groupby("__imp")}

    def posterior(theta, sums):
        """Log density, score and information with each copy's prior."""
        out = {}
        for i, v in sums.items():
            r = ridge[i]
            out[i] = (v[0] - r / 2 * theta[i] @ theta[i], v[1:1 + q] - r * theta[i], v[1 + q:].reshape(q, q) + r * np.eye(q))
        return out

    theta, ridge = {i: np.zeros(q) for i in copies}, {i: 0.0 for i in copies}
    now, open_, move = posterior(theta, at(theta)), set(copies), {}
    for step in range(max_iter):
        for i in sorted(open_):
            if not ridge[i] and (step == max_iter // 3 or not _solvable(now[i][2])):
                ridge[i], theta[i] = PRIOR_SD ** -2, np.zeros(q)
                move.pop(i, None)
                now = now | {i: posterior(theta, at(theta))[i]}
            if i not in move:
                move[i] = np.linalg.solve(now[i][2], now[i][1])
        trial = {i: theta[i] + move[i] if i in open_ else theta[i] for i in copies}
        found = posterior(trial, at(trial))
        for i in list(open_):
            if not found[i][0] >= now[i][0] - 1e-9 * (1 + abs(now[i][0])):
                move[i] = move[i] / 2
                continue
            done = np.max(np.abs(move.pop(i)) / (1 + np.abs(trial[i]))) < tol
            theta[i], now[i] = trial[i], found[i]
            if done and _solvable(now[i][2]):
                open_.discard(i)
        if not open_:
            return {i: (theta[i], now[i][2]) for i in copies}
    raise ArithmeticError(f"a model of categories has not converged in {max_iter} steps")


def _solvable(info: np.ndarray) -> bool:
    return bool(np.isfinite(info).all() and np.linalg.cond(info) < 1e12)


def drawn_category(columns: Sequence, levels: Sequence, star: Mapping[int, np.ndarray], uniform):
    """The level of each row: classes in order until the running sum of the probabilities passes the uniform number."""
    k, p = len(levels), len(columns)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in star[i]]) for i in sorted(star)])
    weights = F.element_at(table, F.col("__imp"))
    links = [F.lit(0.0)]
    for c in range(k - 1):
        link = F.lit(0.0)
        for j, x in enumerate(columns):
            link = link + x * F.element_at(weights, c * p + j + 1)
        links.append(link)
    top = F.greatest(*links) if k > 1 else links[0]
    odds = F.transform(F.array(*links), lambda v: F.exp(v - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    passed = F.aggregate(
        odds, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below")),
        lambda a, b: F.struct((a["sum"] + b).alias("sum"), (a["below"] + (a["sum"] + b < uniform * total).cast("int")).alias("below")),
        lambda a: a["below"])
    return F.element_at(F.array(*[F.lit(v) for v in levels]), F.least(passed, F.lit(k - 1)) + 1)


def _impute_category(copies, key, target, x, lost, m, text, categories, shared):
    miss, levels = F.col(f"__miss_{target}"), categories[target]
    mine = _rows_to_fill(x, lost, target, categories)
    x = [c for c in x if c not in lost]
    columns = _design(x, categories)
    observed = copies.where(~miss).dropna(subset=x) if x else copies.where(~miss)
    if shared:
        observed = observed.where("__imp = 1")
    code = F.coalesce(*[F.when(F.col(target) == v, F.lit(i)) for i, v in enumerate(levels)])
    rows = observed.select("__imp", code.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(columns)]).persist()
    try:
        fits = polytomous_by_copy(rows, len(columns), len(levels), [1] if shared else range(1, m + 1))
    finally:
        rows.unpersist()
    star = {}
    for imp in range(1, m + 1):
        theta, info = fits[1 if shared else imp]
        star[imp] = theta + np.linalg.cholesky(np.linalg.inv(info)) @ hashed_normals(f"{text}|{imp}", len(theta))
    uniform = seeded_uniform(F.concat_ws("|", F.col("__imp").cast("string"), F.col(key).cast("string")), text)
    # the row itself knows all it takes: nothing moves
    return copies.withColumn(target, F.when(mine, drawn_category(columns, levels, star, uniform)).otherwise(F.col(target)))


def pool(estimates: DataFrame, keys: Sequence[str], estimate: str = "mean", variance: str = "var") -> DataFrame:
    """Combine one estimate per completed copy: average, within and between variance, df."""
    m = F.count(F.lit(1))
    table = estimates.groupBy(*keys).agg(
        F.avg(estimate).alias("estimate"), F.avg(variance).alias("within"),
        F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"), m.alias("m"))
    extra = (1 + 1 / F.col("m")) * F.col("between")
    total = F.col("within") + extra
    ratio = F.when(extra > 0, 1 + F.col("within") / extra)
    return table.select(*keys, "estimate", F.sqrt(total).alias("se"), "within", "between",
                        ((F.col("m") - 1) * ratio * ratio).alias("df"), "m")
