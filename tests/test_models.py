"""Fits against direct numpy solutions and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from designstats.operators import glm as G, multilevel as N
from designstats.operators.categorical import multinomial, multinomial_replicates, negbin, ordinal
from designstats.operators.design import Design
from designstats.operators.missing import impute
from designstats.operators.moments import Moments, path_model
from designstats.operators.replicate import as_rep
from designstats.operators.terms import cross, inter, power


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 600
    x, z = rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    eta = 0.3 * x - 0.4 * z + 0.2
    return pd.DataFrame({
        "id": np.arange(n), "c": rng.integers(0, 40, n), "x": x, "z": z,
        "g": np.where(z == 0, "a", np.where(z == 1, "b", "c")),
        "b": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int),
        "k": rng.poisson(np.exp(eta) * rng.gamma(2.0, 0.5, n)).astype(float),
        "y": eta + rng.normal(size=n), "w": rng.uniform(0.5, 2.0, n),
        "o": 1.0 + rng.integers(0, 3, n) + (x > 0),
    })


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).persist()


@pytest.fixture(scope="module")
def design(df):
    return Design.of(df.withColumn("s", F.col("c") % 4), "c", "s", "w", validate=False)


def newton(x, y, w, family):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
        v = mu * (1 - mu) if family == "binomial" else mu
        beta = beta + np.linalg.solve(x.T @ (x * (w * v)[:, None]), x.T @ (w * (y - mu)))
    return beta


@pytest.mark.parametrize("family,y", [("binomial", "b"), ("poisson", "k")])
def test_weighted_coefficients(design, frame, family, y):
    x = np.column_stack([np.ones(len(frame)), frame.x, frame.x**2, frame.z, frame.x * frame.z])
    want = newton(x, frame[y].to_numpy(float), frame.w.to_numpy(), family)
    fit = G.glm(design, y, ["x", power("x", 2), "z", inter("x", "z")], family)
    assert fit.coef == pytest.approx(want, abs=1e-8)
    quasi = G.glm(design, y, ["x", power("x", 2), "z", inter("x", "z")], family, quasi=True)
    assert quasi.vcov == pytest.approx(fit.vcov)


def test_terms_and_wide_sums(design, monkeypatch):
    from designstats.operators import fitting

    items = ["g", *cross(["x", power("x", 2)], "z")]
    narrow = G.glm(design, "y", items)
    assert narrow.terms == ["(Intercept)", "gb", "gc", "x", "x^2", "z", "x:z", "x^2:z"][: len(narrow.terms)]
    monkeypatch.setattr(fitting, "JVM_SUMS", 0)
    # z is a combination of the factor columns, so leave the factor out for the comparison
    items = cross(["x", power("x", 2)], "z")
    wide = G.glm(design, "y", items)
    monkeypatch.setattr(fitting, "JVM_SUMS", 160)
    assert wide.coef == pytest.approx(G.glm(design, "y", items).coef)


def test_nested_tests_agree(df):
    small, large = G.glm(df, "y", ["x"]), G.glm(df, "y", ["x", "z"])
    assert G.anova_f(small, large)["f"] == pytest.approx(G.wald_test(large, ["z"])["f"])
    assert G.lr_test(small, large)["chisq"] == pytest.approx(
        large.n * np.log(small.deviance / large.deviance))


def test_rao_scott_against_wald(design):
    small, large = G.glm(design, "b", ["x"], "binomial"), G.glm(design, "b", ["x", "z"], "binomial")
    lrt, wald = G.rao_scott_lrt(small, large), G.wald_test(large, ["z"])
    assert lrt["p"] == pytest.approx(wald["p"], abs=0.02)
    with pytest.raises(ValueError):
        G.design_bic(small, G.glm(design, "y", ["x"]))


def test_ordinal_and_multinomial_scores(design):
    for fit in (ordinal(design, "o", ["x", "z"]), multinomial(design, "o", ["x", "z"])):
        assert np.max(np.abs(fit.extra["score"])) < 1e-5
        assert np.all(fit.se() > 0)


def test_multinomial_replicates_track_the_sandwich(design):
    rep = as_rep(design, "bootstrap", replicates=60, seed=3)
    fit, values = multinomial_replicates(rep, "g", ["x"])
    spread = {r.term: r.se for r in values.groupBy("term").agg(F.sqrt(F.var_samp("value")).alias("se")).collect()}
    for t, s in zip(fit.terms, fit.se()):
        assert 0.6 < spread[t] / s < 1.6


def test_negbin_score_and_overdispersion(df, frame):
    fit = negbin(df, "k", ["x"])
    assert np.max(np.abs(fit.extra["score"])) < 1e-5
    assert 0.8 < fit.extra["theta"] < 5.0
    assert fit.loglik > G.glm(df, "k", ["x"], "poisson").loglik


def test_balanced_mixed_model_equals_anova(spark):
    rng = np.random.default_rng(2)
    j, n = 30, 6
    y = rng.normal(size=j)[:, None] * 0.8 + rng.normal(size=(j, n))
    rows = pd.DataFrame({"c": np.repeat(np.arange(j), n), "y": y.ravel(), "one": 1.0})
    fit = N.mixed(spark.createDataFrame(rows), "c", "y", [])
    msb = n * y.mean(1).var(ddof=1)
    msw = ((y - y.mean(1, keepdims=True)) ** 2).sum() / (j * (n - 1))
    assert fit.components["Residual"] == pytest.approx(msw, rel=1e-6)
    assert fit.components["c.(Intercept)"] == pytest.approx((msb - msw) / n, rel=1e-6)
    assert fit.coef[0] == pytest.approx(y.mean())
    ml = N.mixed(spark.createDataFrame(rows), "c", "y", [], reml=False)
    weighted = N.mixed(spark.createDataFrame(rows), "c", "y", [], w1="one", w2="one")
    assert weighted.components == {k: pytest.approx(v, rel=1e-6) for k, v in ml.components.items()}
    assert weighted.robust[0, 0] == pytest.approx(y.mean(1).var() / j, rel=1e-6)
    assert weighted.wald_components()["chisq"] > 0


def test_moments_wide_and_narrow(design, frame):
    m = Moments(design, ["x", "z", "y", "k"])
    w = frame.w / frame.w.sum()
    gap = frame[["x", "z", "y", "k"]] - (frame[["x", "z", "y", "k"]].mul(w, axis=0)).sum()
    want = (gap.mul(w, axis=0)).T @ gap * 600 / 599
    assert m.cov == pytest.approx(want.to_numpy())
    wide = m.gamma()  # 14 moments: matrix path
    narrow = Moments(design, ["x", "z", "y"]).gamma()  # 9 moments: SQL path
    assert wide[:3, :3] == pytest.approx(narrow[:3, :3])


def test_path_model_equals_regressions(design):
    path = path_model(design, {"y": ["x", "z"], "k": ["y", "x"]})
    one = G.glm(design, "y", ["x", "z"])
    assert [path[t] for t in ("y~1", "y~x", "y~z")] == pytest.approx(list(one.coef))
    assert path.se("y~x") == pytest.approx(one.se("x"))


def test_imputation_takes_near_donors(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = np.where(np.arange(n) % 3 == 0, 0.25, rng.random(n))  # one predictor value is hot
    y = np.round(10 * x + 0.01 * rng.random(n), 4)
    rows = [(i, float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    done = impute(df, "id", ["y"], ["x"], m=3, donors=5).collect()
    assert len(done) == 3 * n
    gaps = [abs(r.y - 10 * r.x) for r in done if r.id % 7 == 0]
    assert max(gaps) < 0.6 and all(r.y == rows[r.id][2] for r in done if r.id % 7)


def test_imputation_fills_rows_with_null_predictors(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=60), rng.normal(size=60)
    rows = [(i, None if i % 4 == 0 else float(x[i] + z[i]), None if i % 3 == 0 else float(x[i]), None if i % 8 == 4 and i % 3 else float(z[i]),
             None if i % 5 == 0 else float(x[i] - z[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, x double, z double, v double")
    for targets in (["y"], ["y", "v"]):
        done = impute(df, "id", targets, ["x", "z"], m=2, sweeps=2).collect()
        assert len(done) == 120
        for t in targets:
            seen = {r[t] for r in df.collect()} - {None}
            assert all(r[t] in seen for r in done)
    with pytest.raises(ValueError, match="no predictor"):
        impute(df, "id", ["y"], ["x"])


def test_gamma_functions_as_sql(spark):
    from designstats.operators.fitting import digamma_sql, lgamma_sql, trigamma_sql

    xs = [0.05, 0.5, 1.0, 2.5, 9.0, 1234.5, 1e6, 1e9]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(
        "x", f"{lgamma_sql('x')} AS l", f"{digamma_sql('x')} AS d", f"{trigamma_sql('x')} AS t").collect()
    for r in rows:
        assert math.isclose(r.l, math.lgamma(r.x), rel_tol=1e-11, abs_tol=1e-11)
        # recurrences: digamma(x + 1) = digamma(x) + 1 / x, and so on, summed far enough to use the first terms of the series
        far = r.x + 2000
        d = math.log(far) - 0.5 / far - 1 / (12 * far**2) - sum(1 / (r.x + k) for k in range(2000))
        t = 1 / far + 0.5 / far**2 + 1 / (6 * far**3) + sum(1 / (r.x + k) ** 2 for k in range(2000))
        assert math.isclose(r.d, d, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.t, t, rel_tol=1e-9, abs_tol=1e-12)


def test_large_counts_cost_no_arrays(spark):
    """Negative binomial with counts near a million: score and information at the returned size are those of the sample."""
    from designstats.operators.categorical import negbin

    rng = np.random.default_rng(3)
    y = rng.negative_binomial(4, 4 / (4 + 1e6), 400)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(y)], "k int, y double")
    fit = negbin(df, "y", [])
    size, mu = float(fit.extra["theta"]), float(np.mean(y))

    def loglik(s):
        return sum(math.lgamma(v + s) - math.lgamma(s) - math.lgamma(v + 1) + s * math.log(s) + v * math.log(mu)
                   - (v + s) * math.log(mu + s) for v in y.tolist())

    assert math.isclose(math.exp(fit.coef[0]), mu, rel_tol=1e-6)
    best = loglik(size)
    assert best >= max(loglik(size * 1.01), loglik(size * 0.99))
