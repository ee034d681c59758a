"""Pair matching on a score, closest pair first, without replacement.

The rule: of all free treated-control pairs the closest is taken, again and again. On a line only neighbours can be the
closest pair, so the units are put in one total order and cut into stretches, which are worked off at once. A
stretch knows the neighbour beyond each end. Units that might be claimed from there are set aside from the end
inwards as soon as such a claim would be the next in order; every other decision of the stretch is final. What is
left goes into the next round, where the cuts lie elsewhere. Where at last all treated units are on one side of all
controls, the pairs follow from the ranks alone.
"""

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from designstats.operators.frame import range_cells
from designstats.session import checkpoint

#: Hash-free spread of equal scores: part of the order, so that it is the same however the line is cut.
SPREAD = 64


def ordered(units: DataFrame, out: str, slices: int = 256) -> DataFrame:
    """Number the units 0, 1, ... in the order (score descending, id mod SPREAD, id).

    Cells of the score are sorted on their own, those of one score by ``id mod SPREAD``, and the cell sizes are added up
    in a table of bounded size.
    """
    flipped = units.withColumns({"__v": -F.col("score"), "__mod": F.pmod("id", F.lit(SPREAD))})
    cells = range_cells(flipped, "__v", "id", slices).withColumn(
        "__sub", F.when(F.col("__cell") % 2 == 0, F.col("__mod")).otherwise(F.lit(0)))
    spot = ["__cell", "__sub"]
    sizes = cells.groupBy(*spot).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*spot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*spot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*spot).orderBy("__v", "__mod", "id")
    ranked = cells.withColumn("__rn", F.row_number().over(inside)).join(offsets, spot)
    return ranked.withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("long")).select(*units.columns, out)


def closest_in_stretch(pos: list, score: list, treated: list, before: tuple | None, after: tuple | None) -> list[tuple[int, int]]:
    """Pairs (indices) of a sorted stretch that are certain whatever lies beyond; before and after: (pos, score) there.

    Pairs are ordered by (distance, positions apart, upper position).
    """
    n = len(pos)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    rank = lambda a, b: (abs(score[a] - score[b]), pos[b] - pos[a], pos[a])
    heap = [(*rank(i, i + 1), i, i + 1) for i in range(n - 1) if treated[i] != treated[i + 1]]
    heapify(heap)
    first, last, end = 0, n - 1, (float("inf"), 0, 0)
    above, below = {}, {}  # the set-aside units nearest to the middle, by kind

    def claim_top(i):
        if (other := above.get(1 - treated[i])) is not None:
            return rank(other, i)
        return (abs(before[1] - score[i]), pos[i] - before[0], before[0]) if before else end

    def claim_bottom(i):
        if (other := below.get(1 - treated[i])) is not None:
            return rank(i, other)
        return (abs(after[1] - score[i]), after[0] - pos[i], pos[i]) if after else end

    out = []
    while heap and first < last:
        d, g, p, i, j = heap[0]
        if gone[i] or gone[j] or nxt[i] != j or i < first or j > last:
            heappop(heap)
            continue
        top, bottom = claim_top(first), claim_bottom(last)
        if top <= (d, g, p) and top <= bottom:
            above[treated[first]], first = first, nxt[first]
            continue
        if bottom <= (d, g, p):
            below[treated[last]], last = last, prv[last]
            continue
        heappop(heap)
        out.append((i, j))
        gone[i] = gone[j] = True
        a, b = prv[i], nxt[j]
        if a >= 0:
            nxt[a] = b
        if b < n:
            prv[b] = a
        if i == first:
            first = b
        if j == last:
            last = a
        if first <= a and b <= last and treated[a] != treated[b]:
            heappush(heap, (*rank(a, b), a, b))
    return out


def _stretch(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    ids, kinds = pdf["id"].tolist(), pdf["treated"].tolist()
    edge = lambda p, s: None if pd.isna(pdf[p].iloc[0]) else (int(pdf[p].iloc[0]), float(pdf[s].iloc[0]))
    pairs = closest_in_stretch(pdf["pos"].tolist(), pdf["score"].tolist(), kinds, edge("pos_b", "score_b"), edge("pos_a", "score_a"))
    rows = [(ids[i], ids[j]) if kinds[i] else (ids[j], ids[i]) for i, j in pairs]
    return pd.DataFrame(rows, columns=["treated_id", "control_id"], dtype="int64")


def _sides(units: DataFrame):
    """(treated, controls, all treated before all controls, all after)."""
    t = F.col("treated") == 1
    r = units.agg(
        F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias("t"), F.coalesce(F.sum((~t).cast("long")), F.lit(0)).alias("c"),
        F.min(F.when(t, F.col("pos"))).alias("t_lo"), F.max(F.when(t, F.col("pos"))).alias("t_hi"),
        F.min(F.when(~t, F.col("pos"))).alias("c_lo"), F.max(F.when(~t, F.col("pos"))).alias("c_hi")).first()
    both = r.t and r.c
    return r.t, r.c, bool(both and r.t_hi < r.c_lo), bool(both and r.c_hi < r.t_lo)


def _zip(ranked: DataFrame, upper: int, n_upper: int) -> DataFrame:
    """Upper units from the lowest upwards with the lower ones from the highest downwards; upper: their kind."""
    up, low = (f"{'treated' if kind == 1 else 'control'}_id" for kind in (upper, 1 - upper))
    one = ranked.where(F.col("treated") == upper).select(F.col("id").alias(up), (F.lit(n_upper - 1) - F.col("rank")).alias("k"))
    two = ranked.where(F.col("treated") != upper).select(F.col("id").alias(low), (F.col("rank") - F.lit(n_upper)).alias("k"))
    return one.join(two, "k").select("treated_id", "control_id")


def match_closest(rows: DataFrame, key: str, treated: Column, score: Column, limit: int = 100_000, slices: int = 256,
                  log: list | None = None) -> DataFrame:
    """1:1 matching without replacement, closest pair first; treated_id, control_id.

    Rows with a NULL key, role or score take no part; keys must be unique. Units of equal score are in the order (key mod
    64, key); of pairs at the same distance the one with fewer units between comes first, then the upper one. The
    pairs depend on neither ``limit`` (units of a task) nor ``slices``. ``log`` gets the units left before each round.
    """
    units = rows.select(F.col(key).cast("long").alias("id"), treated.cast("int").alias("treated"), score.cast("double").alias("score")).dropna()
    units = checkpoint(ordered(units, "pos", slices))
    pairs, turn = None, 0
    while True:
        n_t, n_c, down, up = _sides(units)
        if not n_t or not n_c:
            break
        if log is not None:
            log.append(n_t + n_c)
        ranked = checkpoint(ordered(units, "rank", slices)) if turn else units.withColumn("rank", F.col("pos"))
        if down or up:
            found = _zip(ranked, 1 if down else 0, n_t if down else n_c)
            pairs = found if pairs is None else pairs.unionByName(found)
            break
        cut = ranked.withColumn("stretch", F.floor((F.col("rank") + (turn % 2) * (limit // 2)) / limit))
        edges = cut.groupBy("stretch").agg(F.min(F.struct("pos", "score")).alias("lo"), F.max(F.struct("pos", "score")).alias("hi"))
        before = edges.select((F.col("stretch") + 1).alias("stretch"), F.col("hi.pos").alias("pos_b"), F.col("hi.score").alias("score_b"))
        after = edges.select((F.col("stretch") - 1).alias("stretch"), F.col("lo.pos").alias("pos_a"), F.col("lo.score").alias("score_a"))
        known = cut.join(before, "stretch", "left").join(after, "stretch", "left")
        found = checkpoint(known.groupBy("stretch").applyInPandas(_stretch, "treated_id long, control_id long"))
        pairs = found if pairs is None else pairs.unionByName(found)
        used = found.select(F.explode(F.array("treated_id", "control_id")).alias("id"))
        units = checkpoint(units.join(used, "id", "left_anti"))
        turn += 1
    return rows.sparkSession.createDataFrame([], "treated_id long, control_id long") if pairs is None else pairs
