"""Plain table operators: counts, shares, reshapes, numbering, exact quantiles."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BROADCAST_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left keys."""
    if not on:
        raise ValueError("no join keys")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in on], *[c for c in right.columns if c not in on]
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in on])


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach a lookup table to rows without moving the rows when the table is small.

    At most ``max_rows`` + 1 rows of the table are fetched to see its size. A table within the
    bound is kept as a literal relation and broadcast (a cached one would stop Spark from
    recognising equal shuffles above it). A larger one is joined by key, where adaptive
    execution splits hot keys.
    """
    head = table.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        small = rows.sparkSession.createDataFrame(head, table.schema)
        return rows.join(F.broadcast(small), list(on), how)
    return rows.join(table, list(on), how)


def count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_share(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Counts with their share overall, or inside the ``within`` groups."""
    from designstats.operators.estimate import with_share

    return with_share(count(df, *within, *keys), "n", list(within), "prop")


def group_attach(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Keep the rows and add group-wise aggregates to each of them.

    A window would sort every group inside one task; the groups are aggregated first and
    joined back instead. The join is left to adaptive execution: broadcast when the table of
    groups turns out small, otherwise by key with hot groups split.
    """
    table = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return null_safe_join(df, table, list(keys), "left") if keys else df.join(table)


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack tables by name with a tag column; absent columns become NULL."""
    parts = [t.withColumn(tag, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str | Sequence[str],
            names: Sequence[str]) -> DataFrame:
    """Spread one or several value columns over the given names."""
    values = [value] if isinstance(value, str) else list(value)
    grouped = df.groupBy(*ids).pivot(name, list(names))
    return grouped.agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def prediction_grid(spark, **axes: Sequence) -> DataFrame:
    """Every combination of the given value lists (a report-sized grid of literals)."""
    grid = spark.range(1).select()
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def number_rows(df: DataFrame, by: Sequence[str], key: str, out: str = "rn") -> DataFrame:
    """Number the rows 1..n of every group in the order (hash bucket of key, key).

    The bucket is the first byte of md5(key). Numbering runs inside (group, bucket) windows
    plus an offset per bucket, so that one huge group is spread over 256 tasks. ``key`` must
    be unique inside a group.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 2), 16, 10)
    rows = df.withColumn("__b", bucket.cast("int"))
    sizes = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, "__b").orderBy(key)
    numbered = rows.withColumn(out, F.row_number().over(inside))
    joined = null_safe_join(numbered, offsets, [*by, "__b"])
    return joined.withColumn(out, F.col(out) + F.col("__off")).drop("__b", "__off")


def rank_select(rows: DataFrame, targets: Sequence[float], bins: int = 2048) -> list[float]:
    """For each target t the smallest x with sum(w; values <= x) >= t. Columns: x, w.

    Exact selection by repeated histograms: each pass sums the weights in ``bins`` equal
    slices of the open brackets and keeps the slice that holds the target. A slice whose
    smallest and largest value agree is the answer. No pass sorts or moves the rows; only
    bin sums reach the driver. The first pass narrows the brackets by ``bins``, and only the
    rows left inside are kept for the later ones.
    """
    edge = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if edge.lo is None:
        return [None] * len(targets)
    # per target: bracket [lo, hi] and the weight below it
    state = [(edge.lo, edge.hi, 0.0) for _ in targets]
    within = lambda lo, hi: (F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi))
    left = None
    try:
        while True:
            open_ = sorted({s for s in state if s[0] < s[1]})
            if not open_:
                return [s[0] for s in state]
            source = rows if left is None else left
            slices = []
            for i, (lo, hi, _) in enumerate(open_):
                step = (hi - lo) / bins
                cell = F.floor((F.col("x") - F.lit(lo)) / F.lit(step)) if step > 0 else F.lit(0)
                cell = F.least(cell.cast("long"), F.lit(bins - 1).cast("long"))
                slices.append(F.when(within(lo, hi), F.struct(F.lit(i).alias("i"), cell.alias("c"))))
            hits = source.select("x", "w", F.explode(F.array_compact(F.array(*slices))).alias("s"))
            table = (
                hits.groupBy("s.i", "s.c")
                .agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                .orderBy("i", "c")
                .collect()
            )
            for k, (target, (lo, hi, below)) in enumerate(zip(targets, state)):
                if lo >= hi:
                    continue
                i = open_.index((lo, hi, below))
                mine = [r for r in table if r.i == i]
                reached = lambda weight: weight >= target * (1 - 1e-12)
                for j, r in enumerate(mine):
                    if reached(below + r.w) or j == len(mine) - 1:
                        state[k] = (r.lo, r.hi, below)
                        if (r.lo, r.hi) == (lo, hi):  # neighbours too close to slice further
                            at_lo = source.where(F.col("x") == lo).agg(F.sum("w")).first()[0]
                            state[k] = (lo, lo, below) if reached(below + at_lo) else (hi, hi, below)
                        break
                    below += r.w
            if left is None:
                inside = F.lit(False)
                for lo, hi, _ in state:
                    inside = inside | within(lo, hi)
                left = rows.where(inside).persist()
    finally:
        if left is not None:
            left.unpersist()


def quantile_type7(df: DataFrame, x: str, probs: Sequence[float]) -> DataFrame:
    """Sample quantiles with linear interpolation between order statistics."""
    rows = df.where(F.col(x).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.lit(1.0).alias("w")
    )
    n = rows.count()
    spots = [(n - 1) * p for p in probs]
    wanted = sorted({int(s) + k for s in spots for k in (1, 2) if int(s) + k <= n})
    values = dict(zip(wanted, rank_select(rows, [float(k) for k in wanted])))
    result = []
    for p, s in zip(probs, spots):
        lo = values[int(s) + 1]
        hi = values.get(int(s) + 2, lo)
        result.append((float(p), lo + (s - int(s)) * (hi - lo)))
    return df.sparkSession.createDataFrame(result, "p double, quantile double")


def mean_interval(df: DataFrame, x: str, groups: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Plain mean with t interval, overall or per group."""
    from designstats.functions.dist import t_quantile_col

    table = df.groupBy(*groups).agg(
        F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"),
        F.count(x).alias("n"),
    )
    half = t_quantile_col(0.5 + level / 2, F.col("n") - 1) * F.col("se")
    return table.withColumns({"low": F.col("mean") - half, "upp": F.col("mean") + half})


def fpc_constancy(df: DataFrame, cluster: str, fpc: str) -> DataFrame:
    """How many clusters have 1, 2, ... distinct fpc values."""
    per = df.groupBy(cluster).agg(F.countDistinct(fpc).alias("n_fpc"))
    return count(per, "n_fpc")


def crosstab(df: DataFrame, row: str, column: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(names)).agg(F.count(F.lit(1))).na.fill(0)


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlation of every pair, one pass over the rows, in long form."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
                      for a, b in pairs])
    return one.select(F.inline(cells))


def jackknife_mean(df: DataFrame, x: str) -> DataFrame:
    """Delete-one means summarised: their mean and (n-1) times their sum of squares."""
    totals = df.agg(F.sum(x).alias("s"), F.count(x).alias("n"), F.avg(x).alias("m")).select(
        F.struct("s", "n", "m").alias("t")
    ).scalar()
    left_out = (totals.getField("s") - F.col(x)) / (totals.getField("n") - 1)
    # the average of the delete-one means is the mean itself
    gap = left_out - totals.getField("m")
    n1 = totals.getField("n") - 1
    return df.where(F.col(x).isNotNull()).agg(
        F.avg(left_out).alias("jack_mean"), (F.first(n1) * F.sum(gap * gap)).alias("jack_var"),
    )


def factor_levels(df: DataFrame, name: str) -> list:
    """Sorted distinct codes of a categorical column, which become terms or columns of a report."""
    return sorted(r[0] for r in df.where(F.col(name).isNotNull()).select(name).distinct().collect())


def as_factor(df: DataFrame, name: str, labels: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """Text factor whose labels go by position in the sorted codes."""
    from designstats.functions.columns import recode

    levels = factor_levels(df, name)
    labels = [str(v) for v in levels] if labels is None else list(labels)
    if len(labels) != len(levels):
        raise ValueError(f"{len(levels)} levels but {len(labels)} labels")
    return df.withColumn(out or name, recode(name, dict(zip(levels, labels))))


def range_cells(df: DataFrame, value: str, key: str, slices: int = 256, split: int = 64,
                out: tuple[str, str] = ("__cell", "__sub")) -> DataFrame:
    """Put rows into ordered cells of about equal size, robust against heavy ties.

    Cut points are approximate quantiles of ``value`` (a bounded list on the driver). A value
    that equals a cut point gets a cell of its own, which is split further by a hash of
    ``key``; any other cell lies strictly between two cut points.
    """
    from pyspark.ml.feature import Bucketizer

    cuts = df.approxQuantile(value, [i / slices for i in range(slices + 1)], 0.25 / slices)
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumns({out[0]: F.lit(0), out[1]: F.lit(0)})
    edges = [float("-inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=edges, inputCol=value, outputCol="__bucket").transform(df)
    lower = F.element_at(F.array(*[F.lit(float(c)) for c in edges]), F.col("__bucket").cast("int") + 1)
    tied = F.col(value) == lower
    cell = (2 * F.col("__bucket")).cast("int") + F.when(tied, 0).otherwise(1)
    sub = F.when(tied, F.pmod(F.xxhash64(key), F.lit(split))).otherwise(F.lit(0)).cast("int")
    return placed.withColumns({out[0]: cell, out[1]: sub}).drop("__bucket")


def running_count(df: DataFrame, by: Sequence[str], value: str, key: str, counted: Column,
                  out: str = "rank", slices: int = 256) -> DataFrame:
    """Running number of ``counted`` rows in the order (value, key) within ``by`` groups.

    Sorting happens inside range cells, the cell totals are accumulated in a small table and
    added back, so no task holds a whole group. Rows with tied values at a cut point are
    ordered by hash instead of key.
    """
    cells = range_cells(df.withColumn("__hit", counted.cast("long")), value, key, slices)
    spot = ["__cell", "__sub"]
    sizes = cells.groupBy(*by, *spot).agg(F.sum("__hit").alias("__n"))
    before = Window.partitionBy(*by).orderBy(*spot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, *spot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, *spot).orderBy(value, key).rowsBetween(Window.unboundedPreceding, 0)
    counted_rows = cells.withColumn(out, F.sum("__hit").over(inside))
    # the offset table has at most 2 * slices * split rows per group
    joined = null_safe_join(counted_rows, offsets, [*by, *spot])
    return joined.withColumn(out, F.col(out) + F.col("__off")).drop(*spot, "__off", "__hit")
