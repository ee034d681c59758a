"""Imputation of factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from designstats.operators.categorical import multinomial
from designstats.operators.missing import impute, polytomous_by_copy


def rows(spark, n=400):
    r = np.random.default_rng(6)
    data = []
    for i in range(n):
        x, g = float(r.normal()), "uv"[int(r.integers(0, 2))]
        c = "abc"[int(np.argmax([0.0, x + r.gumbel(), 0.5 * (g == "v") + r.gumbel()] + r.gumbel(size=3) * 0.1))]
        data.append((i, x, None if i % 17 == 0 else g, None if i % 5 == 0 else c, None if i % 7 == 0 else 2 * x + (c == "b")))
    return spark.createDataFrame(data, "id long, x double, g string, c string, y double").repartition(4)


def test_fits_of_copies_are_the_models(spark):
    df = rows(spark).dropna()
    code = F.coalesce(*[F.when(F.col("c") == v, k) for k, v in enumerate("abc")])
    fit = multinomial(df, "c", ["x"], y_levels=["a", "b", "c"])
    both = df.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("__imp"), code.alias("y"), F.lit(1.0).alias("x0"), F.col("x").alias("x1"))
    got = polytomous_by_copy(both, 2, 3, [1, 2])
    for imp in (1, 2):
        assert np.allclose(got[imp][0], fit.coef, atol=1e-6)
        assert np.allclose(np.linalg.inv(got[imp][1]), fit.naive, atol=1e-6)


def test_factors_and_numbers_in_turn(spark):
    df = rows(spark)
    kinds = {"c": ["a", "b", "c"], "g": ["u", "v"]}
    done = impute(df, "id", ["c", "y", "g"], ["x"], m=2, sweeps=2, categories=kinds).collect()
    was = {r.id: r for r in df.collect()}
    assert len(done) == 2 * len(was)
    for r in done:
        assert r.c in "abc" and r.g in "uv" and r.y is not None
        assert all(was[r.id][k] in (None, r[k]) for k in ("c", "g", "y"))
    again = impute(df.repartition(7), "id", ["c"], ["x"], m=2, categories=kinds).collect()
    assert {(r.id, r["__imp"], r.c) for r in again} == {(r.id, r["__imp"], r.c) for r in impute(df, "id", ["c"], ["x"], m=2, categories=kinds).collect()}


def test_rows_without_a_predictor_use_the_others(spark):
    done = impute(rows(spark), "id", ["c"], ["x", "g"], m=1, categories={"c": ["a", "b", "c"], "g": ["u", "v"]}).collect()
    assert all(r.c in "abc" for r in done)


def test_unknown_and_unseen_levels_raise(spark):
    df = rows(spark)
    with pytest.raises(ValueError, match="outside the levels: c"):
        impute(df, "id", ["c"], ["x"], m=1, categories={"c": ["a", "b"]})
    with pytest.raises(ValueError, match="without an observed row"):
        impute(df, "id", ["c"], ["x"], m=1, categories={"c": ["a", "b", "c", "d"]})
