"""Replicate weights by vectors, and refits, against the definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from designstats.operators.categorical import ordinal
from designstats.operators.design import PSU, STR, WT, Design
from designstats.operators.glm import glm
from designstats.operators.refits import ordinal_moments, replicate_glm, replicate_ordinal, replicate_totals, split_draws
from designstats.operators.replicate import as_rep, fast_walsh


def test_split_draws_deal_all_draws_evenly():
    drawn = split_draws(3, "s", 37, 4000, np.arange(37))
    assert (drawn.sum(axis=0) == 37).all()
    assert abs(drawn.mean(axis=1) - 1).max() < 0.1 and abs(drawn.var(axis=1) - 36 / 37).max() < 0.15
    assert abs(np.cov(drawn[0], drawn[36])[0, 1] + 1 / 37) < 0.08
    some = np.array([0, 5, 6, 20, 36])
    assert (split_draws(3, "s", 37, 4000, some) == drawn[some]).all()  # whatever else a task holds
    assert (split_draws(4, "s", 37, 50, some) != drawn[some, :50]).any()
    assert (split_draws(3, "s", 1, 5, np.array([0])) == 1).all()


def rows(spark, n=900):
    r = np.random.default_rng(5)
    data = []
    for i in range(n):
        psu = int(r.integers(0, 24))
        x = float(r.integers(0, 3))
        y = int(np.clip(np.round(x / 2 + r.normal(0, 0.8) + psu % 3 * 0.3), 0, 2))
        data.append((psu, "AB"[psu % 2], 1.0 + float(r.random()), x, y, int(r.random() < 1 / (1 + np.exp(0.5 - 0.4 * x))), None if i % 4 == 0 else "k"))
    return spark.createDataFrame(data, "psu int, strata string, w double, x double, y int, b int, g string").repartition(5)


def design(df, **more):
    return Design.of(df, "psu", "strata", "w", **more)


def multiples(rep, reps):
    """(stratum, PSU) -> how often it is drawn, by the definition on all PSUs of a stratum."""
    numbered = rep._numbered().collect()
    out = {}
    for s in {r[STR] for r in numbered}:
        own = sorted((r for r in numbered if r[STR] == s), key=lambda r: r["rn"])
        drawn = split_draws(rep.seed, str(s), len(own), reps, np.arange(len(own)))
        out |= {(s, r[PSU]): drawn[k] for k, r in enumerate(own)}
    return out


@pytest.mark.parametrize("kind,fpc", [("bootstrap", False), ("bootstrap", True), ("Fay", False), ("BRR", False)])
def test_totals_by_vectors(spark, kind, fpc):
    df = rows(spark).withColumn("fpc", F.lit(0.36))
    rep = as_rep(design(df, **({"fpc": "fpc"} if fpc else {})), kind, replicates=30, seed=9)
    psu = rep.design.domain_rows().groupBy(STR, PSU, "g").agg(F.sum(WT).alias("a"), F.sum(F.col(WT) * F.col("x")).alias("c"))
    got = replicate_totals(rep, psu, ["g"], ["a", "c"]).collect()
    if kind == "bootstrap":
        drawn, lam, want = multiples(rep, 30), 0.8 if fpc else 1.0, {}
        for p in psu.collect():
            f = 1 - lam + lam * drawn[p[STR], p[PSU]]
            for k in range(30):
                a, c = want.get((str(k + 1), p.g), (0.0, 0.0))
                want[str(k + 1), p.g] = (a + f[k] * p.a, c + f[k] * p.c)
    else:
        want = {(str(int(r.rep) + 1), r.g): (r.a, r.c) for r in rep.totals(psu, ["g"], ["a", "c"]).collect()}
    assert len(got) == len(want)
    for r in got:
        assert np.allclose((r.a, r.c), want[r.rep, r.g])
        assert np.isclose(r.full_a, sum(p.a for p in psu.collect() if p.g == r.g)) if r.rep == "1" else True


def test_refits_equal_fits_with_the_replicate_weights(spark):
    df = rows(spark).drop("g")
    rep = as_rep(design(df), "bootstrap", replicates=4, seed=2)
    drawn = multiples(rep, 4)
    factor = spark.createDataFrame([(s, p, [float(v) for v in m]) for (s, p), m in drawn.items()], "strata string, psu int, m array<double>")
    weighted = df.join(factor, ["strata", "psu"])
    for fit, values, again in (
        (*replicate_glm(rep, "b", ["x"], "binomial"), lambda d: glm(d, "b", ["x"], "binomial", weights="v")),
        (*replicate_ordinal(rep, "y", ["x"], [0, 1, 2]), lambda d: ordinal(d, "y", ["x"], weights="v", y_levels=[0, 1, 2])),
    ):
        got = {(r.rep, r.term): r.value for r in values.collect()}
        for k in (0, 3):
            one = again(weighted.withColumn("v", F.col("w") * F.col("m")[k]).where("v > 0"))
            assert all(abs(got[str(k + 1), t] - one[t]) < 1e-6 for t in fit.terms)


def test_a_jackknife_has_no_vectors(spark):
    with pytest.raises(ValueError, match="replicate for every PSU"):
        replicate_glm(as_rep(design(rows(spark)), "JKn"), "b", ["x"], "binomial")


def half_weights(rep, reps):
    """(stratum, PSU) -> the factors of a half-sample design, by the definition."""
    return {(r[STR], r[PSU]): [1 + (1 - rep.rho) * r["__sign"] * (-1) ** (k & r["__g"]).bit_count() for k in range(reps)] for r in rep.pairs().collect()}


@pytest.mark.parametrize("kind,y,family", [("Fay", "x", "gaussian"), ("BRR", "b", "binomial"), ("Fay", "y", "ordinal")])
def test_half_sample_refits_weigh_no_row_in_every_replicate(spark, monkeypatch, kind, y, family):
    def no_rows(*_):
        raise AssertionError("every row met every replicate")

    monkeypatch.setattr("designstats.operators.refits.placed_psus", no_rows)
    df = rows(spark).drop("g").withColumn("z", F.col("y") + 0.5 * F.col("b"))
    rep = as_rep(design(df), kind)
    items = ["z"] if family == "gaussian" else ["b"] if family == "ordinal" else ["x"]
    if family == "ordinal":
        (fit, values), again = replicate_ordinal(rep, y, items, [0, 1, 2]), lambda d: ordinal(d, y, items, weights="v", y_levels=[0, 1, 2])
    else:
        (fit, values), again = replicate_glm(rep, y, items, family), lambda d: glm(d, y, items, family, weights="v")
    reps = rep.scheme()["reps"]
    got = {(r.rep, r.term): r.value for r in values.collect()}
    assert len(got) == reps * len(fit.terms)
    factor = spark.createDataFrame([(s, p, f) for (s, p), f in half_weights(rep, reps).items()], "strata string, psu int, f array<double>")
    weighted = df.join(factor, ["strata", "psu"])
    for k in (0, reps // 2 + 1):
        one = again(weighted.withColumn("v", F.col("w") * F.col("f")[k]).where("v > 0"))
        assert all(abs(got[str(k + 1), t] - one[t]) < 1e-6 for t in fit.terms)


def test_the_fast_transform_is_the_matrix_product():
    line = np.random.default_rng(1).normal(size=(3, 64))
    signs = 1 - 2 * (np.bitwise_count(np.arange(64)[:, None] & np.arange(64)) % 2).astype(float)
    assert np.allclose(fast_walsh(line), line @ signs)


@pytest.mark.parametrize("p", [0, 2])
def test_ordinal_moments_by_definition_without_a_pass_per_replicate(p, monkeypatch):
    r = np.random.default_rng(3)
    n, reps, cuts = 150, 7, 3
    x, y, w = r.normal(size=(n, p)), r.integers(0, cuts + 1, n).astype(float), r.random((n, reps))
    beta = np.column_stack([np.sort(r.normal(size=(reps, cuts))), r.normal(size=(reps, p))])
    monkeypatch.setattr("designstats.operators.refits.CACHED", 300)
    exponentials = []
    own = np.exp
    monkeypatch.setattr(np, "exp", lambda v: exponentials.append(1) or own(v))
    score, info = ordinal_moments(cuts)(x, y, beta, w)
    monkeypatch.undo()
    assert len(exponentials) == 4 * (cuts + 1)  # 4 stretches of rows, whatever the number of replicates
    for k in range(reps):
        below = np.column_stack([np.zeros(n), *[1 / (1 + np.exp(x @ beta[k, cuts:] - c)) for c in beta[k, :cuts]], np.ones(n)])
        slope, want, matrix = below * (1 - below), np.zeros(cuts + p), np.zeros((cuts + p, cuts + p))
        for c in range(cuts + 1):
            grad = np.zeros((n, cuts + p))
            if c < cuts:
                grad[:, c] += slope[:, c + 1]
            if c:
                grad[:, c - 1] -= slope[:, c]
            grad[:, cuts:] = (slope[:, c] - slope[:, c + 1])[:, None] * x
            v = w[:, k] / (below[:, c + 1] - below[:, c])
            want += (v * (y == c)) @ grad
            matrix += (grad * v[:, None]).T @ grad
        assert np.allclose(score[k], want) and np.allclose(info[k], matrix)
