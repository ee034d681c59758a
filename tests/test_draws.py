"""Bootstrap draws: counts of a PSU in every replicate, and totals from them."""

import math

import pytest
from pyspark.sql import functions as F

from designstats.operators import replicate
from designstats.operators.categorical import multinomial_replicates
from designstats.operators.design import PSU, STR, Design
from designstats.operators.replicate import as_rep


def _rep(spark, sizes=(("a", 40), ("b", 3), ("c", 17)), replicates=30):
    rows = [(s, f"{s}{i}", float(1 + i % 3), 0.36) for s, n in sizes for i in range(n)]
    d = Design.of(spark.createDataFrame(rows, "s string, p string, w double, f double"), "p", "s", "w", "f")
    return as_rep(d, "bootstrap", replicates, seed=7)


def _dealt(rep):
    """stratum, rn, replicate -> times, by the definition in Spark's own functions."""
    text = F.concat_ws("|", F.lit("7"), F.col("rep").cast("string"), F.col(STR), F.col("i").cast("string"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    deals = rep.design.strata().select(STR, "n_h", F.explode(F.expr("sequence(1L, n_h)")).alias("i"))
    deals = deals.select("*", F.explode(F.expr(f"sequence(1, {rep.replicates})")).alias("rep"))
    rows = deals.groupBy(STR, (number % F.col("n_h") + 1).alias("rn"), "rep").count().collect()
    return {(r[STR], r.rn, r.rep): r["count"] for r in rows}


@pytest.mark.parametrize("held", [1 << 20, 150])
def test_draws_are_packed_by_psu(spark, monkeypatch, held):
    """One row for each PSU, not one for each draw; short stretches and narrow blocks deal the same."""
    monkeypatch.setattr(replicate, "DEALT", held)
    monkeypatch.setattr(replicate, "COUNTED", held)
    rep = _rep(spark)
    got = rep.draws().collect()
    assert len(got) == 60
    times = {(r[STR], r.rn, i + 1): n for r in got for i, n in enumerate(r.times) if n}
    assert times == _dealt(rep)


def test_totals_of_draws(spark):
    """Sums over the draws (0.8 of them, with 0.2 of all), with NULL keys, NULL values, an infinite value and a key that few replicates meet."""
    rep = _rep(spark)
    place = {(r[STR], r[PSU]): r.rn for r in rep._numbered().collect()}
    cells = [("a", f"a{i}", None if i % 5 == 0 else i % 2, None if i % 4 == 0 else float(i)) for i in range(40)]
    cells += [("b", "b0", 7, 2.5), ("c", "c1", 8, None), ("c", "c2", 9, math.inf), ("c", "c3", 9, 1.0)]
    psu = spark.createDataFrame(cells, f"{STR} string, {PSU} string, k int, t double")
    want, dealt = {}, _dealt(rep)
    for s, p, k, t in cells:
        for r in range(1, 31):
            if n := dealt.get((s, place[s, p], r)):
                want.setdefault((str(r), k), []).extend([] if t is None else [n * t])
    got = {(r.rep, r.k): r.t for r in rep.totals(psu, ["k"], ["t"]).collect()}
    assert got.keys() == want.keys()
    full = {k: sum(t for *_, key, t in cells if key == k and t is not None) for k in {c[2] for c in cells}}
    for at, parts in want.items():
        if parts:
            assert got[at] == pytest.approx(0.8 * sum(parts) + 0.2 * full[at[1]])
        else:
            assert got[at] is None


def test_multinomial_replicates_are_weighted_fits(spark):
    """A saturated model: its slopes are log ratios of the replicate's weighted counts."""
    rows = [(s, f"{s}{p}", float(1 + i % 3), "xyz"[(i * p + i) % 3], str((i + p) % 2))
            for s in "ab" for p in range(12) for i in range(15)]
    d = Design.of(spark.createDataFrame(rows, "s string, p string, w double, y string, f string"), "p", "s", "w")
    rep = as_rep(d, "bootstrap", 5, seed=7)
    _, values = multinomial_replicates(rep, "y", ["f"], levels={"f": ["0", "1"]}, y_levels=["x", "y", "z"])
    got = {(r.rep, r.term): r.value for r in values.collect()}
    place = {(r[STR], r[PSU]): r.rn for r in rep._numbered().collect()}
    dealt = _dealt(rep)
    for r in range(1, 6):
        n = {}
        for s, p, w, y, f in rows:
            n[y, f] = n.get((y, f), 0.0) + w * dealt.get((s, place[s, p], r), 0)
        for c, y in ((1, "y"), (2, "z")):
            first = math.log(n[y, "0"] / n["x", "0"])
            assert got[str(r), f"(Intercept):{c}"] == pytest.approx(first, abs=1e-7)
            assert got[str(r), f"f1:{c}"] == pytest.approx(math.log(n[y, "1"] / n["x", "1"]) - first, abs=1e-7)


def test_draws_are_not_broadcast(spark):
    """Their table grows with the PSUs, whatever the planner makes of the few strata it comes from."""
    rep = _rep(spark)
    cells = [("a", f"a{i}", i % 2, float(i)) for i in range(40)]
    totals = rep.totals(spark.createDataFrame(cells, f"{STR} string, {PSU} string, k int, t double"), ["k"], ["t"])
    totals.collect()
    plan = totals._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "rn#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
