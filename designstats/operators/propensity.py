"""Propensity scores: weights, exact greedy matching, balance, effect tables."""

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from designstats.functions.columns import if_else
from designstats.operators.fitting import Fit
from designstats.operators.frame import range_cells
from designstats.session import checkpoint


def iptw(treated: Column, score: Column) -> Column:
    """Inverse probability of the treatment received."""
    return if_else(treated, 1.0 / score, 1.0 / (1.0 - score))


def _ordered(units: DataFrame, slices: int) -> DataFrame:
    """Cells and order columns for the sweep: score descending, treated before controls."""
    flipped = units.withColumns({"__v": -F.col("score"), "__mod": F.pmod(F.xxhash64("id"), F.lit(64))})
    cells = range_cells(flipped, "__v", "id", slices)
    # inside a tied cell all treated slices come before all control slices; the slice is part of the order everywhere
    sub = F.when(F.col("treated") == 1, F.col("__mod")).otherwise(F.col("__mod") + 1000)
    tied = F.col("__cell") % 2 == 0
    return cells.withColumn("__sub", F.when(tied, sub).otherwise(0)).withColumn("__late", 1 - F.col("treated"))


_SPOT = ["__cell", "__sub"]
_ORDER = ["__v", "__late", "__mod", "id"]


def _windows():
    # frames that end at the last row are worked out anew for every row, so looking onward is looking back from the end
    inside = Window.partitionBy(*_SPOT).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*_SPOT).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    # cell tables are bounded by the number of slices, so these run in one small task
    before = Window.orderBy(*_SPOT).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*[F.desc(c) for c in _SPOT]).rowsBetween(Window.unboundedPreceding, -1)
    return inside, onward, before, after


def _independent_runs(units: DataFrame, slices: int) -> DataFrame:
    """Number the units in sweep order (``pos``) and label runs that cannot interact (``run``).

    A run ends where no treated unit above can be pushed below, even if all of them took the
    next free control downwards, and none from below can be pushed above. Both bounds are
    queue lengths, i.e. differences between prefix sums and their running extremes. They are
    computed per cell and joined by a cell table of bounded size.
    """
    inside, onward, before, after = _windows()
    step = F.when(F.col("treated") == 1, 1).otherwise(-1)
    rows = _ordered(units, slices).withColumn("step", step.cast("long"))
    rows = rows.withColumns({"s": F.sum("step").over(inside), "k": F.count(F.lit(1)).over(inside)})
    rows = rows.withColumns({"lo": F.min("s").over(inside), "hi": F.max("s").over(onward)})
    # the order must stay the same for all further uses of the numbering
    rows = checkpoint(rows)
    cells = rows.groupBy(*_SPOT).agg(F.sum("step").alias("total"), F.count(F.lit(1)).alias("size"),
                                     F.min("s").alias("cell_lo"), F.max("s").alias("cell_hi"))
    cells = cells.withColumns({"off": F.coalesce(F.sum("total").over(before), F.lit(0)),
                               "base": F.coalesce(F.sum("size").over(before), F.lit(0))})
    cells = cells.withColumns({
        "prev_lo": F.least(F.lit(0), F.coalesce(F.min(F.col("off") + F.col("cell_lo")).over(before), F.lit(0))),
        "next_hi": F.max(F.col("off") + F.col("cell_hi")).over(after),
    })
    full = rows.join(F.broadcast(cells.select(*_SPOT, "off", "base", "prev_lo", "next_hi")), _SPOT)
    p = F.col("off") + F.col("s")
    down = p - F.least(F.col("prev_lo"), F.col("off") + F.col("lo"))
    best = F.greatest(F.col("off") + F.col("hi"), F.coalesce(F.col("next_hi"), F.col("off") + F.col("hi")))
    up = F.greatest(F.lit(0), best - (p - F.col("step")))
    full = full.select("id", "treated", "score", *_SPOT, *[c for c in _ORDER if c != "id"],
                       (F.col("base") + F.col("k")).alias("pos"), p.alias("p"), down.alias("down"), up.alias("up"),
                       (F.col("off") - F.col("prev_lo")).alias("down_before_cell"))
    # a run starts where up = 0 and the position before has down = 0
    # by position: rows of a repeated id have the same place in the order, but only one position each
    ordered = Window.partitionBy(*_SPOT).orderBy("pos")
    before_me = F.coalesce(F.lag("down").over(ordered), F.col("down_before_cell"))
    marked = full.withColumn("before", before_me).withColumn("cut", ((F.col("up") == 0) & (F.col("before") == 0)).cast("int"))
    marked = marked.withColumn("r", F.sum("cut").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*_SPOT).agg(F.sum("cut").alias("cuts"))
    runs = runs.select(*_SPOT, F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("run0"))
    return marked.join(F.broadcast(runs), _SPOT).select(
        "id", "treated", "score", "pos", "before", ((F.col("pos") - F.col("p")) / 2).cast("long").alias("nc"),
        ((F.col("pos") + F.col("p")) / 2).cast("long").alias("nt"), (F.col("run0") + F.col("r")).alias("run"))


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy matching of one bounded stretch, from the highest score down.

    ``open_top`` / ``open_end`` tell that further controls exist outside the stretch; the
    sweep stops before the first decision that would need them.
    """
    pdf = pdf.sort_values("pos")
    ids, scores, treated = pdf["id"].tolist(), pdf["score"].tolist(), pdf["treated"].tolist()
    open_top, open_end = bool(pdf["open_top"].iloc[0]), bool(pdf["open_end"].iloc[0])
    controls = [i for i, t in enumerate(treated) if t == 0]
    above, taken, passed, out = [], 0, 0, []
    for i, is_treated in enumerate(treated):
        if not is_treated:
            if passed < taken:
                pass  # already taken from above
            else:
                above.append(i)
                taken = passed + 1
            passed += 1
            continue
        nxt = controls[taken] if taken < len(controls) else None
        if (open_end and (nxt is None or passed == len(controls))) or (open_top and not above):
            break
        if nxt is None and not above:
            out.append((ids[i], None))
        elif nxt is not None and (not above or scores[i] - scores[nxt] <= scores[above[-1]] - scores[i]):
            out.append((ids[i], ids[nxt]))
            taken += 1
        else:
            out.append((ids[i], ids[above.pop()]))
    return pd.DataFrame(out, columns=["treated_id", "control_id"], dtype="object").astype({"treated_id": "int64"}).assign(
        control_id=lambda d: d["control_id"].astype("Int64"))


def _equal_scores(placed: DataFrame) -> DataFrame:
    """Pairs of equal score that are certain, all at once.

    Where nothing from above can reach a block of equal scores, its treated units take its
    controls one by one, so the k-th of one kind is paired with the k-th of the other.
    """
    is_treated = F.col("treated") == 1
    blocks = placed.groupBy("score").agg(
        F.min_by("before", "pos").alias("reach"), F.min(F.when(is_treated, F.col("nt"))).alias("nt0"),
        F.min(F.when(~is_treated, F.col("nc"))).alias("nc0"))
    blocks = blocks.where("reach = 0 and nt0 is not null and nc0 is not null")
    ranked = placed.join(blocks, "score").withColumn(
        "rank", F.when(is_treated, F.col("nt") - F.col("nt0")).otherwise(F.col("nc") - F.col("nc0")))
    left = ranked.where(is_treated).select("score", "rank", F.col("id").alias("treated_id"))
    right = ranked.where(~is_treated).select("score", "rank", F.col("id").alias("control_id"))
    return left.join(right, ["score", "rank"]).select("treated_id", "control_id")


def match_nearest(rows: DataFrame, key: str, treated: Column, score: Column, limit: int = 100_000,
                  slices: int = 256) -> DataFrame:
    """1:1 nearest matching on a score without replacement, largest score first.

    The result is that of the sequential greedy rule. Treated units of equal score are taken in
    hash order; of two controls at the same distance the one at or below comes first.
    The line of units is cut into runs that cannot interact; runs are swept in parallel, many
    per task, never more than about two ``limit`` units in one task. In a longer run the
    certain pairs of equal score are taken out first, whatever their number; then it is worked
    off in stretches of ``limit``, keeping only decisions its stretch can settle, and the rest
    goes into the next round.

    Returns treated_id, control_id.
    """
    units = rows.select(F.col(key).cast("long").alias("id"), treated.cast("int").alias("treated"), score.alias("score"))
    units = units.dropna()
    pairs = None
    while True:
        placed = checkpoint(_independent_runs(units, slices))
        sizes = placed.groupBy("run").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first"),
                                          F.max("pos").alias("last"), F.sum("treated").alias("t"),
                                          F.min(F.when(F.col("treated") == 1, F.struct("pos", "nt", "nc"))).alias("ft"))
        placed = checkpoint(placed.join(sizes.where("t > 0"), "run"))  # runs without treated units are done
        short = placed.where(F.col("size") <= limit).select(
            F.floor(F.col("first") / limit).alias("batch"), "id", "treated", "score", "pos",
            F.lit(False).alias("open_top"), F.lit(False).alias("open_end"))
        long_ = placed.where(F.col("size") > limit)
        todo, ties = short, None
        more = not long_.isEmpty()
        if more:
            ties = checkpoint(_equal_scores(long_))
            if ties.isEmpty():
                ties = None
                # a stretch holds the first limit treated units with limit controls on either side
                place = F.when(F.col("treated") == 1, F.col("nt") - F.col("ft.nt")).otherwise(F.col("nc") - F.col("ft.nc") - 1)
                n_above = F.col("ft.pos") - F.col("first")
                todo = short.unionByName(long_.where((place >= -limit) & (place < limit)).select(
                    (-F.col("first")).alias("batch"), "id", "treated", "score", "pos", (n_above > limit).alias("open_top"),
                    (F.col("size") - F.col("t") - n_above > limit).alias("open_end")))
        found = checkpoint(todo.groupBy("batch").applyInPandas(_sweep, "treated_id long, control_id long"))
        found = found if ties is None else found.unionByName(ties)
        pairs = found if pairs is None else pairs.unionByName(found)
        if not more:
            return pairs.where(F.col("control_id").isNotNull())
        used = found.select(F.col("treated_id").alias("id")).unionByName(
            found.where(F.col("control_id").isNotNull()).select(F.col("control_id").alias("id")))
        units = long_.select("id", "treated", "score").join(used, "id", "left_anti")


def matched_rows(rows: DataFrame, key: str, score: str, pairs: DataFrame) -> DataFrame:
    """Rows of all pairs with ``distance`` (the score), ``weights`` 1 and the pair id ``subclass``."""
    sides = F.array(F.col("treated_id"), F.col("control_id"))
    member = pairs.select(F.col("treated_id").alias("subclass"), F.explode(sides).alias(key))
    return rows.join(member, key).withColumns({"distance": F.col(score), "weights": F.lit(1.0)})


def balance(rows: DataFrame, treated: str, covariates: Sequence[str], weight: str | None = None) -> DataFrame:
    """Weighted group means and their standardised difference, one pass for all covariates."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = []
    for i, c in enumerate(covariates):
        for g in (0, 1):
            inside = (F.col(treated) == g) & F.col(c).isNotNull()
            sums.append((F.sum(F.when(inside, w * F.col(c))) / F.sum(F.when(inside, w))).alias(f"m{i}_{g}"))
        sums.append(F.stddev_samp(F.when(F.col(treated) == 1, F.col(c))).alias(f"s{i}"))
    one = rows.agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(c).alias("covariate"), F.col(f"m{i}_1").alias("mean_treated"), F.col(f"m{i}_0").alias("mean_control"),
                 ((F.col(f"m{i}_1") - F.col(f"m{i}_0")) / F.col(f"s{i}")).alias("std_diff"))
        for i, c in enumerate(covariates)])
    return one.select(F.inline(cells))


def effect_table(fits: Mapping[str, Fit], term: str, spark, traits: Mapping[str, Mapping[str, object]] | None = None,
                 df: float | None = None) -> DataFrame:
    """One row per model, in the given order: the effect of a term, its interval, and the model's traits as columns."""
    rows = None
    for place, (model, fit) in enumerate(fits.items(), 1):
        own = fit.confint(spark, df=df).where(F.col("term") == term)
        named = {name: F.lit(value) for name, value in (traits or {}).get(model, {}).items()}
        own = own.select(F.lit(place).alias("place"), F.lit(model).alias("model"), "estimate", "low", "upp", *[c.alias(n) for n, c in named.items()])
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows
