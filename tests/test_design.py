"""Design invariants: domains, validation, and agreement between variance methods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from designstats.functions.dist import INF
from designstats.operators import estimate as E
from designstats.operators.design import Design
from designstats.operators.fitting import total_covariance
from designstats.operators.replicate import as_rep, even_strata
from designstats.plans.fixtures import order_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return order_rows(spark, SF).persist()


@pytest.fixture(scope="module")
def design(rows):
    return Design.of(rows, "cluster", "strata", "w", validate=False)


def one(table):
    return table.first()


def test_domain_is_not_a_prefilter(rows, design):
    domain = design.filter(F.col("rid") % 4 == 0)
    filtered = Design.of(rows.where("rid % 4 = 0"), "cluster", "strata", "w", validate=False)
    a, b = one(E.survey_mean(domain, "y", df=INF)), one(E.survey_mean(filtered, "y", df=INF))
    assert a["mean"] == pytest.approx(b["mean"])
    assert a["se"] != pytest.approx(b["se"], rel=1e-6)
    assert domain.degf() == design.degf() > filtered.degf()


def test_grouped_means_equal_domain_means(design):
    grouped = {r.grp3: r for r in E.survey_mean(design.group_by("grp3"), "y", df=INF).collect()}
    for g, r in grouped.items():
        alone = one(E.survey_mean(design.filter(F.col("grp3") == g), "y", df=INF))
        assert r["mean"] == pytest.approx(alone["mean"]) and r["se"] == pytest.approx(alone["se"])


def test_weight_scale_does_not_matter(rows, design):
    scaled = Design.of(rows.withColumn("w", F.col("w") * 1000), "cluster", "strata", "w", validate=False)
    a, b = one(E.survey_mean(design, "y")), one(E.survey_mean(scaled, "y"))
    assert a["mean"] == pytest.approx(b["mean"]) and a["se"] == pytest.approx(b["se"])


def test_simple_random_sample(rows):
    srs = Design.of(rows, "rid", validate=False)
    plain = one(rows.agg(F.avg("y").alias("m"), (F.stddev_samp("y") / F.sqrt(F.count("y"))).alias("se")))
    got = one(E.survey_mean(srs, "y"))
    assert got["mean"] == pytest.approx(plain.m) and got["se"] == pytest.approx(plain.se)


def test_deff_is_stable_far_from_zero(rows, design):
    far = Design.of(rows.withColumn("z", F.col("y") + 1e7), "cluster", "strata", "w", validate=False)
    a = one(E.survey_means(design, ["y"], deff=True, df=INF))
    b = one(E.survey_means(far, ["z"], deff=True, df=INF))
    assert a["deff"] == pytest.approx(b["deff"], rel=1e-5)


def test_validation(spark):
    def build(data, **kw):
        df = spark.createDataFrame(data, "s string, c int, w double, f double")
        return Design.of(df, "c", "s", "w", "f", **kw)

    good = [("a", 1, 1.0, 9.0), ("a", 2, 1.0, 9.0), ("b", 3, 1.0, 9.0), ("b", 4, 2.0, 9.0)]
    build(good)
    with pytest.raises(ValueError, match="positive"):
        build([*good, ("a", 1, 0.0, 9.0)])
    with pytest.raises(ValueError, match="constant"):
        build([*good, ("a", 1, 1.0, 8.0)])
    with pytest.raises(ValueError, match="single"):
        build([*good, ("c", 9, 1.0, 9.0)])
    with pytest.raises(ValueError, match="several strata"):
        build([*good, ("b", 1, 1.0, 9.0)])
    with pytest.raises(ValueError, match="smaller"):
        build([(s, c, w, 1.5) for s, c, w, _ in good])


def test_lonely_stratum_fails_at_run_time(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 2.0)], "s string, c int, x double")
    design = Design.of(df, "c", "s", validate=False)
    with pytest.raises(Exception, match="single PSU"):
        E.survey_mean(design, "x", df=INF).collect()
    kept = Design.of(df, "c", "s", validate=False, lonely="remove")
    assert one(E.survey_mean(kept, "x", df=INF))["se"] > 0


def test_jackknife_equals_taylor_for_totals(design):
    taylor = {r.female: r for r in E.survey_total(design.group_by("female"), "y").collect()}
    jack = {r.female: r for r in as_rep(design, "JKn").group_by("female").survey_total("y").collect()}
    for g, r in taylor.items():
        assert jack[g].total == pytest.approx(r.total) and jack[g].se == pytest.approx(r.se)


def test_half_samples_equal_taylor_for_paired_totals(rows):
    """With two PSUs per stratum all half-samples are balanced."""
    paired = rows.withColumn("strata", F.floor(F.col("cluster") / 2))
    counts = paired.select("strata", "cluster").distinct().groupBy("strata").count().where("count = 2")
    design = Design.of(paired.join(counts, "strata", "left_semi"), "cluster", "strata", "w", validate=False)
    taylor = one(E.survey_total(design, "y"))
    for kind in ("BRR", "Fay"):
        got = one(as_rep(design, kind).survey_total("y"))
        assert got.total == pytest.approx(taylor.total) and got.se == pytest.approx(taylor.se)


def test_half_samples_refuse_odd_strata(design):
    if any(r.n_h % 2 for r in design.strata().collect()):
        with pytest.raises(ValueError, match="even number"):
            as_rep(design, "BRR")
    assert all(r.n_h % 2 == 0 for r in even_strata(design).strata().collect())


def test_bootstrap_does_not_depend_on_partitions(rows):
    found = []
    for parts in (1, 17):
        d = Design.of(rows.repartition(parts), "cluster", "strata", "w", validate=False)
        found.append(one(as_rep(d, "bootstrap", replicates=25).survey_means(["y"], df=INF)))
    assert found[0]["mean"] == pytest.approx(found[1]["mean"])
    assert found[0]["se"] == pytest.approx(found[1]["se"])
    taylor = one(E.survey_mean(Design.of(rows, "cluster", "strata", "w", validate=False), "y", df=INF))
    assert 0.5 < found[0]["se"] / taylor["se"] < 2.0


def test_single_scan_of_the_rows(spark):
    """The grouped mean reads its rows once: both uses of the PSU cells share one shuffle."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    design = Design.of(rows, "l_suppkey", None, F.lit(1.0), validate=False)
    table = E.survey_mean(design.group_by("l_returnflag"), "l_quantity", df=INF)
    table.collect()
    plan = table._jdf.queryExecution().executedPlan()
    scans = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ReusedExchangeExec":
            return None
        if name == "FileSourceScanExec":
            scans.append(node.requiredSchema().simpleString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len([s for s in scans if "l_quantity" in s]) == 1


@pytest.mark.parametrize("role", ["st", "psu", "w", "f"])
def test_null_roles_are_refused(spark, role):
    rows = spark.createDataFrame([(1, 1, 1.0, 10.0, 2.0), (1, 2, 1.0, 10.0, 3.0), (2, 3, 1.0, 10.0, 4.0), (2, 4, 1.0, 10.0, 5.0)],
                                 "st int, psu int, w double, f double, y double")
    broken = rows.withColumn(role, F.when(F.col("y") > 2, F.col(role)))
    design = Design.of(broken, ids="psu", strata="st", weights="w", fpc="f", validate=False)
    with pytest.raises(Exception, match="NULL"):
        E.survey_total(design, "y").collect()
    whole = Design.of(rows, ids="psu", strata="st", weights="w", fpc="f", validate=False)
    assert E.survey_total(whole, "y").collect()


@pytest.mark.parametrize("lonely", ["remove", "adjust", "average"])
@pytest.mark.parametrize("q", [12, 13])
def test_wide_covariance_for_every_lonely_policy(spark, lonely, q):
    r = np.random.default_rng(q)
    strata = [1, 1, 1, 2, 2, 3, 4, 4]
    values = r.normal(size=(8, q))
    names = [f"t{k}" for k in range(q)]
    rows = [(s, p, 1.0, *map(float, v)) for p, (s, v) in enumerate(zip(strata, values))]
    df = spark.createDataFrame(rows, "st int, psu int, w double, " + ", ".join(f"{n} double" for n in names))
    design = Design.of(df, ids="psu", strata="st", weights="w", validate=False, lonely=lonely)
    psu = design.df.groupBy("__str", "__psu").agg(*[F.sum(n).alias(n) for n in names])
    want = np.zeros((q, q))
    for s in set(strata):
        own = values[[k for k, x in enumerate(strata) if x == s]]
        n = len(own)
        if n > 1:
            gap = own - own.mean(axis=0)
            want += n / (n - 1) * gap.T @ gap
        elif lonely == "adjust":
            want += own.T @ own
    if lonely == "average":
        want *= 4 / 3
    assert np.allclose(total_covariance(design, psu, names), want, atol=1e-9)
