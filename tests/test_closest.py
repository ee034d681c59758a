"""Closest-first matching against the rule written out."""

import random

import pytest
from pyspark.sql import functions as F

from designstats.operators.closest import closest_in_stretch, match_closest


def by_rule(units):
    """units: (id, treated, score); every pair by (distance, positions apart, upper position)."""
    line = sorted(units, key=lambda u: (-u[2], u[0] % 64, u[0]))
    pos = {u[0]: k for k, u in enumerate(line)}
    pairs = [(abs(a[2] - b[2]), abs(pos[a[0]] - pos[b[0]]), min(pos[a[0]], pos[b[0]]), a[0], b[0]) for a in units if a[1] for b in units if not b[1]]
    out, used = {}, set()
    for *_, t, c in sorted(pairs):
        if t not in used and c not in used:
            out[t] = c
            used |= {t, c}
    return out


def line(seed, n, share, step=None, hot=False, kind="mixed"):
    r, units = random.Random(seed), []
    for i in range(n):
        t = int(r.random() < share) if kind == "mixed" else int(i < n * share)
        s = r.random() + (0.4 * t if kind == "mixed" else 2.0 * t)
        units.append((i * 7 + 1, t, 0.5 if hot and i % 3 == 0 else round(s / step) * step if step else s))
    return units


@pytest.mark.parametrize("seed,n,share,limit,step,hot,kind", [
    (1, 300, 0.4, 1000, None, False, "mixed"), (2, 300, 0.6, 40, None, False, "mixed"), (3, 300, 0.3, 16, 0.05, False, "mixed"),
    (4, 240, 0.5, 30, None, True, "mixed"), (5, 200, 0.3, 20, None, False, "sides"), (6, 200, 0.7, 500, None, False, "sides"),
])
def test_equals_the_rule(spark, seed, n, share, limit, step, hot, kind):
    units = line(seed, n, share, step, hot, kind)
    df = spark.createDataFrame(units, "id long, treated int, score double").repartition(3)
    log = []
    got = {r.treated_id: r.control_id for r in match_closest(df, "id", F.col("treated"), F.col("score"), limit, 8, log).collect()}
    assert got == by_rule(units)
    assert len(log) < 12


def test_order_of_cuts_and_nulls(spark):
    units = [*line(9, 150, 0.5), (None, 1, 0.1), (9001, None, 0.2), (9002, 0, None)]
    df = spark.createDataFrame(units, "id long, treated int, score double")
    got = {tuple(sorted(map(tuple, match_closest(df, "id", F.col("treated"), F.col("score"), limit, slices).collect()))) for limit, slices in ((9, 4), (50, 16))}
    assert got == {tuple(sorted(by_rule(line(9, 150, 0.5)).items()))}
    assert match_closest(df.where("treated = 1"), "id", F.col("treated"), F.col("score")).count() == 0
    assert match_closest(df.limit(0), "id", F.col("treated"), F.col("score")).count() == 0


def test_a_stretch_decides_only_what_is_certain():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(4, 24)
        units = [(k, r.randint(0, 1), r.random()) for k in range(n)]
        order = sorted(units, key=lambda u: (-u[2], u[0] % 64, u[0]))
        lo, hi = sorted(r.sample(range(n + 1), 2))
        part = order[lo:hi]
        edge = lambda k: (k, order[k][2]) if 0 <= k < n else None
        got = closest_in_stretch(list(range(lo, hi)), [u[2] for u in part], [u[1] for u in part], edge(lo - 1), edge(hi))
        want = by_rule(units)
        for i, j in got:
            t, c = (part[i][0], part[j][0]) if part[i][1] else (part[j][0], part[i][0])
            assert want[t] == c
