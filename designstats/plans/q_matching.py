"""Closest-first matching (O) queries."""

from pyspark.sql import functions as F

from designstats.operators import propensity as O
from designstats.operators.closest import match_closest
from designstats.plans.fixtures import order_rows, with_orders
from designstats.plans.registry import query
from designstats.plans.q_models import rounded

# Rounds of mutual nearest neighbours: each free unit chooses the nearest of the other kind, by (distance, positions
# apart, upper position), which names the pair; two units that choose the same pair are one.
_LAST = "last_value(CASE WHEN t = {k} THEN row(s, pos) END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NEXT = "first_value(CASE WHEN t = {k} THEN row(s, pos) END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_CLOSEST = f"""u AS (SELECT rid id, sad t, y s, row_number() OVER (ORDER BY y DESC, rid % 64, rid) - 1 pos FROM d),
r AS (
  SELECT 0 it, id, t, s, pos, CAST(NULL AS HUGEINT) mate FROM u
  UNION ALL
  SELECT it + 1, id, t, s, pos, CASE WHEN count(*) OVER p = 2 THEN sum(id) OVER p - id END
  FROM (SELECT *, CASE WHEN up IS NULL THEN down WHEN down IS NULL OR up < down THEN up ELSE down END best FROM (
    SELECT it, id, t, s, pos, t0, t1, CASE WHEN a IS NOT NULL THEN row(a[1] - s, pos - a[2], a[2]) END up,
      CASE WHEN b IS NOT NULL THEN row(s - b[1], b[2] - pos, pos) END down FROM (
      SELECT *, CASE WHEN t = 1 THEN {_LAST.format(k=0)} ELSE {_LAST.format(k=1)} END a,
        CASE WHEN t = 1 THEN {_NEXT.format(k=0)} ELSE {_NEXT.format(k=1)} END b, min(t) OVER () t0, max(t) OVER () t1
      FROM r WHERE mate IS NULL) WHERE t0 <> t1)) WINDOW p AS (PARTITION BY best)),
pairs AS (SELECT id treated_id, CAST(mate AS BIGINT) control_id FROM r WHERE t = 1 AND mate IS NOT NULL)"""


def _pairs(spark, sf):
    rows = order_rows(spark, sf)
    return rows, match_closest(rows, "rid", F.col("sad") == 1, F.col("y"))


def recursive(sql: str) -> str:
    return with_orders(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("o02_closest_first", recursive(_CLOSEST + " SELECT treated_id, control_id FROM pairs"))
def o02_closest(spark, sf):
    """Pairs of orders with the nearest price, the closest pair first."""
    return _pairs(spark, sf)[1]


@query("o03_closest_rows", recursive(_CLOSEST + """, m AS (SELECT treated_id subclass, treated_id rid FROM pairs UNION ALL SELECT treated_id, control_id FROM pairs)
SELECT rid, subclass, round(y, 8) distance, 1.0::DOUBLE weights FROM m JOIN d USING (rid)"""))
def o03_closest(spark, sf):
    """The rows of all pairs, with the pair they belong to."""
    rows, pairs = _pairs(spark, sf)
    return rounded(O.matched_rows(rows, "rid", "y", pairs).select("rid", "subclass", "distance", "weights"), 8)


@query("o04_closest_difference", recursive(_CLOSEST + """, e AS (SELECT a.happy - b.happy g FROM pairs JOIN d a ON a.rid = treated_id JOIN d b ON b.rid = control_id)
SELECT count(*) n, round(avg(g), 8) estimate, round(stddev_samp(g) / sqrt(count(*)), 8) std_error FROM e"""))
def o04_closest(spark, sf):
    """Mean difference of the outcome within pairs, and its error."""
    rows, pairs = _pairs(spark, sf)
    matched = O.matched_rows(rows, "rid", "y", pairs)
    own = F.when(F.col("sad") == 1, F.col("happy")).otherwise(-F.col("happy"))
    gaps = matched.groupBy("subclass").agg(F.sum(own).alias("g"))
    return rounded(gaps.agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("estimate"), (F.stddev_samp("g") / F.sqrt(F.count("g"))).alias("std_error")), 8)
