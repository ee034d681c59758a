"""Selection and numbering without a single-task sort, under ties, skew and any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from designstats.operators import frame as X


@pytest.mark.parametrize("parts", [1, 17])
def test_rank_select_matches_sorting(spark, parts):
    rng = random.Random(parts)
    # a third of the rows share one value, and the rest spans many orders of magnitude
    values = [7.0 if i % 3 == 0 else 10 ** rng.uniform(-8, 12) for i in range(600)]
    weights = [float(rng.randint(1, 5)) for _ in values]
    df = spark.createDataFrame(list(zip(values, weights)), "x double, w double").repartition(parts)
    order = np.argsort(values)
    cum = np.cumsum(np.array(weights)[order])
    targets = [p * cum[-1] for p in (0.01, 0.25, 0.4, 0.5, 0.9, 1.0)]
    want = [np.array(values)[order][np.searchsorted(cum, t - 1e-9)] for t in targets]
    assert X.rank_select(df, targets) == want


def test_quantile_type7(spark):
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.p: r.quantile for r in X.quantile_type7(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert got == {p: pytest.approx(np.quantile(values, p)) for p in got}


def test_running_count_with_heavy_ties(spark):
    rng = random.Random(3)
    rows = [(i, 0.5 if i % 3 == 0 else rng.random(), int(rng.random() < 0.4)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double, hit int").repartition(5)
    got = X.running_count(df, [], "v", "id", F.col("hit") == 1, "rank", slices=16).collect()
    assert len(got) == 500
    by_value = sorted(got, key=lambda r: (r.v, r["rank"]))
    # ranks never fall along the order, and every counted row has its own number
    assert all(a["rank"] <= b["rank"] for a, b in zip(by_value, by_value[1:]) if a.v < b.v)
    assert sorted(r["rank"] for r in got if r.hit) == list(range(1, sum(r[2] for r in rows) + 1))


def test_number_rows_is_a_numbering(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(200 if g == "a" else 5)], "g string, k long")
    for parts in (1, 9):
        got = X.number_rows(df.repartition(parts), ["g"], "k").collect()
        assert sorted(r.rn for r in got if r.g == "a") == list(range(1, 201))
        key = {(r.g, r.k): r.rn for r in got}
        first = key if parts == 1 else first
        assert key == first


def test_lookup_join_beyond_the_bound(spark):
    rows = spark.createDataFrame([(i % 4, i) for i in range(20)], "k int, v int")
    table = spark.createDataFrame([(k, k * 10) for k in range(4)], "k int, t int")
    small = X.lookup_join(rows, table, ["k"]).orderBy("v").collect()
    large = X.lookup_join(rows, table, ["k"], max_rows=2).orderBy("v").collect()
    assert small == large and len(small) == 20


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 3, 3.0), (None, 4, 5.0)], "g string, k long, x double")
    numbered = {(r.g, r.k): r.rn for r in X.number_rows(rows, ["g"], "k").collect()}
    assert len(numbered) == 4 and sorted(v for (g, _), v in numbered.items() if g is None) == [1, 2]
    attached = {r.k: r.m for r in X.group_attach(rows, ["g"], m=F.avg("x")).collect()}
    assert attached == {1: 1.5, 2: 1.5, 3: 4.0, 4: 4.0}
    ranks = {r.k: r["rank"] for r in X.running_count(rows, ["g"], "x", "k", F.lit(True)).collect()}
    assert ranks == {1: 1, 2: 2, 3: 1, 4: 2}
