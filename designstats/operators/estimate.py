"""Design-based (Taylor) estimates: counts, totals, means, tables, quantiles, histograms."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from designstats.functions import dist
from designstats.functions.columns import col
from designstats.operators.design import PSU, STR, WT, Design
from designstats.operators.frame import null_safe_join, rank_select

Z95 = 1.959963984540054


def interval(table: DataFrame, est: str, se: str, df, level: float = 0.95,
             low: str = "low", upp: str = "upp") -> DataFrame:
    """Add est -/+ quantile * se. ``df`` is a number, a Column, or infinity for the normal."""
    half = dist.t_quantile_col(0.5 + level / 2, df) * F.col(se)
    return table.withColumns({low: F.col(est) - half, upp: F.col(est) + half})


def survey_count(
    design: Design, *cells: str, ci: bool = False, level: float = 0.95, df=None, prop: bool = False
) -> DataFrame:
    """Weighted count of every cell with its standard error.

    With ``prop`` the share within the group (or overall without groups) is added.
    """
    keys = [*design.groups, *cells]
    psu = design.domain_rows().groupBy(STR, PSU, *keys).agg(F.sum(WT).alias("t"))
    table = design.total_variance(psu, keys, {"v": ("t", "t")}, {"n": F.sum("t")})
    table = table.select(*keys, "n", F.sqrt("v").alias("n_se"))
    if ci:
        table = interval(table, "n", "n_se", design.degf() if df is None else df, level,
                         "n_low", "n_upp")
    if prop:
        table = with_share(table, "n", design.groups, "prop")
    return table


def with_share(table: DataFrame, value: str, within: Sequence[str], out: str) -> DataFrame:
    """Share of ``value`` in its group, or in the whole table when ``within`` is empty."""
    if not within:
        return table.withColumn(out, F.try_divide(F.col(value), table.agg(F.sum(value).alias("s")).scalar()))
    totals = table.groupBy(*within).agg(F.sum(value).alias("__total"))
    joined = null_safe_join(table, totals, within)
    return joined.withColumn(out, F.try_divide(value, "__total")).drop("__total")


def survey_total(design: Design, x: str | Column, level: float = 0.95, df=dist.INF) -> DataFrame:
    keys = list(design.groups)
    v = col(x)
    psu = design.domain_rows().groupBy(STR, PSU, *keys).agg(
        F.coalesce(F.sum(F.col(WT) * v), F.lit(0.0)).alias("t")
    )
    table = design.total_variance(psu, keys, {"v": ("t", "t")}, {"total": F.sum("t")})
    table = table.select(*keys, "total", F.sqrt("v").alias("se"))
    return interval(table, "total", "se", df, level)


def mean_cells(design: Design, variables: dict[str, Column], with_squares: bool,
               keys: Sequence[str] | None = None) -> DataFrame:
    """One pass over the rows: per (stratum, PSU, group, variable) n, sum w, sum wx, sum wx2.

    Each variable has its own domain (its non-NULL rows). Squares are taken around the plain
    average of the variable, which keeps them accurate when the mean is far from zero.
    """
    keys = list(design.groups) if keys is None else list(keys)
    rows = design.domain_rows()
    w = F.col(WT)
    aggs, structs = [], []
    for i, (name, x) in enumerate(variables.items()):
        known = x.isNotNull()
        aggs += [
            F.sum(F.when(known, F.lit(1)).otherwise(F.lit(0))).alias(f"n{i}"),
            F.sum(F.when(known, w)).alias(f"w{i}"),
            F.sum(w * x).alias(f"wx{i}"),
        ]
        fields = [F.lit(name).alias("variable"), F.col(f"n{i}").alias("n"),
                  F.col(f"w{i}").alias("sw"), F.col(f"wx{i}").alias("swx")]
        if with_squares:
            shift = rows.agg(F.avg(x).alias("c")).scalar()
            aggs += [F.sum(w * (x - shift) * (x - shift)).alias(f"wxx{i}"), F.first(shift).alias(f"c{i}")]
            fields += [F.col(f"wxx{i}").alias("swxx"), F.col(f"c{i}").alias("c")]
        structs.append(F.struct(*fields))
    cells = rows.groupBy(STR, PSU, *keys).agg(*aggs)
    long = cells.select(STR, PSU, *keys, F.inline(F.array(*structs)))
    # every column is used here, so both consumers below share one shuffle of the rows
    filled = (F.col("n") > 0) & F.col("sw").isNotNull() & F.col("swx").isNotNull()
    if with_squares:
        filled = filled & F.col("swxx").isNotNull() & F.col("c").isNotNull()
    return long.where(filled)


def survey_means(
    design: Design,
    variables: Sequence[str] | dict[str, Column],
    level: float = 0.95,
    df=None,
    deff: bool = False,
) -> DataFrame:
    """Means of many variables in one pass over the rows, for every group of the design.

    Columns: groups, variable, mean, se, var, cv, low, upp, n [, deff].
    """
    if not isinstance(variables, dict):
        variables = {v: F.col(v).cast("double") for v in variables}
    keys = [*design.groups, "variable"]
    cells = mean_cells(design, variables, deff)
    totals = [F.sum("n").alias("n"), F.sum("sw").alias("pop"), (F.sum("swx") / F.sum("sw")).alias("mean")]
    if deff:
        shifted = F.col("mean") - F.first("c")
        totals += [F.sum("swxx").alias("sxx"), F.first("c").alias("c")]
    by_key = cells.groupBy(*keys).agg(*totals)
    # without groups there is one row per variable, so this side is small by construction
    small = by_key if design.groups else F.broadcast(by_key)
    lookup = small.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("pop").alias("kN"),
                          F.col("mean").alias("kmean"))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"k_{k}"))
        match = same if match is None else match & same
    psu = cells.join(lookup, match).select(
        STR, PSU, *keys, ((F.col("swx") - F.col("kmean") * F.col("sw")) / F.col("kN")).alias("t")
    )
    variance = design.total_variance(psu, keys, {"var": ("t", "t")})
    table = null_safe_join(by_key, variance, keys)
    table = table.withColumns({"se": F.sqrt("var")}).withColumn("cv", F.try_divide("se", "mean"))
    table = interval(table, "mean", "se", design.degf() if df is None else df, level)
    out = [*keys, "mean", "se", "var", "cv", "low", "upp", "n"]
    if deff:
        gap = F.col("mean") - F.col("c")
        spread = (F.col("sxx") - F.col("pop") * gap * gap) / F.col("pop")
        spread = F.try_divide(spread * F.col("n"), F.col("n") - 1)
        srs = (F.col("pop") - F.col("n")) / F.col("pop") * spread / F.col("n")
        table = table.withColumn("deff", F.try_divide(F.col("var"), srs))
        out.append("deff")
    return table.select(*out)


def survey_mean(design: Design, x: str | Column, **options) -> DataFrame:
    """Mean of one variable (see ``survey_means``)."""
    variables = {x if isinstance(x, str) else "x": col(x).cast("double")}
    return survey_means(design, variables, **options).drop("variable")


def weighted_mean(rows: DataFrame, x: str | Column, w: str = WT) -> Column:
    """Weighted mean of the non-NULL rows, as a scalar subquery (one row by construction)."""
    v = col(x)
    total = F.sum(F.when(v.isNotNull(), F.col(w)))
    return rows.agg((F.sum(F.col(w) * v) / total).alias("m")).scalar()


def centre(design: Design, *names: str, weighted: bool = True) -> Design:
    """Subtract the (weighted) mean from each named column, all means from one pass."""
    rows = design.domain_rows()
    means = []
    for name in names:
        x = F.col(name)
        if weighted:
            m = F.sum(F.col(WT) * x) / F.sum(F.when(x.isNotNull(), F.col(WT)))
        else:
            m = F.avg(x)
        means.append(m.alias(name))
    one = rows.agg(F.struct(*means).alias("m")).scalar()
    return design.mutate(**{name: F.col(name) - one.getField(name) for name in names})


def survey_var(design: Design, x: str | Column) -> DataFrame:
    """Population variance estimate n/(n-1) * weighted mean of squares, with its SE."""
    v = col(x).cast("double")
    rows = design.domain_rows().where(v.isNotNull())
    m = weighted_mean(rows, v)
    n = rows.agg((F.count(F.lit(1)) / (F.count(F.lit(1)) - 1)).alias("r")).scalar()
    narrowed = design.filter(v.isNotNull())
    table = survey_means(narrowed, {"x": (v - m) * (v - m) * n}, df=dist.INF)
    return table.select(F.col("mean").alias("variance"), "se")


def survey_table(design: Design, *cells: str) -> DataFrame:
    """Weighted contingency table in long form."""
    return design.domain_rows().groupBy(*cells).agg(F.sum(WT).alias("n"))


def prop_table(table: DataFrame, margin: Sequence[str] = (), value: str = "n") -> DataFrame:
    return with_share(table, value, margin, "prop")


def survey_quantile(design: Design, x: str, probs: Sequence[float]) -> DataFrame:
    """Smallest x whose cumulative weight reaches p times the total weight."""
    rows = design.domain_rows().where(F.col(x).isNotNull())
    rows = rows.select(F.col(x).cast("double").alias("x"), F.col(WT).alias("w"))
    total = rows.agg(F.sum("w")).first()[0]
    found = rank_select(rows, [p * total for p in probs])
    spark = design.df.sparkSession
    return spark.createDataFrame(list(zip(map(float, probs), found)), "p double, quantile double")


def histogram(rows: DataFrame, x: str, breaks: Sequence[float], weight: str | None = None) -> DataFrame:
    """Density per right-closed bin of equal width (the first bin includes its lower end)."""
    lo, width, bins = float(breaks[0]), float(breaks[1] - breaks[0]), len(breaks) - 1
    w = F.lit(1.0) if weight is None else F.col(weight)
    known = rows.where(F.col(x).isNotNull())
    index = F.ceil((F.col(x) - lo) / width) - 1
    index = F.least(F.greatest(index, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(index.alias("bin")).agg(F.sum(w).alias("weight"))
    total = counts.agg(F.sum("weight").alias("s")).scalar()
    return counts.select(
        "bin", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("mids"),
        (F.col("weight") / total / width).alias("density"),
    )


# A step of 2, 5 or 10 is taken once the raw step (in powers of ten) exceeds these.
STEP_LIMITS = ((7.0, 10.0), (2.8, 5.0), (1.4, 2.0))


def pretty_breaks(lo: float, hi: float, n: int) -> list[float]:
    """Round break points covering [lo, hi], about n of them, in steps of 1, 2 or 5 times 10^k."""
    raw = (hi - lo) / max(n, 1)
    base = 10.0 ** math.floor(math.log10(raw))
    step = base * next((unit for limit, unit in STEP_LIMITS if raw / base > limit), 1.0)
    first, last = math.floor(lo / step + 1e-7), math.ceil(hi / step - 1e-7)
    return [k * step for k in range(first, last + 1)]


def default_breaks(rows: DataFrame, x: str) -> list[float]:
    """Sturges class count on the range of the data."""
    row = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    return pretty_breaks(float(row.lo), float(row.hi), math.ceil(math.log2(row.n) + 1))
