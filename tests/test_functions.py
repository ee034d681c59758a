"""Distribution routines and column helpers against known values."""

import pytest
from pyspark.sql import functions as F

from designstats.functions import columns as C, dist as D


def test_quantiles_and_tails():
    assert D.t_ppf(0.975, 10) == pytest.approx(2.2281388520, abs=1e-9)
    assert D.t_ppf(0.975, 1) == pytest.approx(12.7062047364, abs=1e-7)
    assert D.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert D.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert D.f_sf(4.1028210, 2, 10) == pytest.approx(0.05, abs=1e-7)
    assert D.t_sf(2.2281388520, 10) == pytest.approx(0.025, abs=1e-10)


def test_mixture_tails():
    assert D.mixture_sf(5.0, [1.3]) == pytest.approx(D.chi2_sf(5 / 1.3, 1), abs=1e-12)
    assert D.mixture_sf(5.0, [0.7, 0.7]) == pytest.approx(D.chi2_sf(5 / 0.7, 2), abs=1e-12)
    assert D.mixture_sf(5.0, [1.3], 30) == pytest.approx(D.f_sf(5 / 1.3, 1, 30), abs=1e-9)
    assert D.mixture_sf(4.0, [1.2, 0.4, 0.3], 1e6) == pytest.approx(D.mixture_sf(4.0, [1.2, 0.4, 0.3]), abs=1e-5)
    assert D.saddlepoint_sf(6.0, [1.0, 0.5, 0.5]) == pytest.approx(D.mixture_sf(6.0, [1.0, 0.5, 0.5]), rel=0.05)


def test_null_rules_and_text(spark):
    df = spark.createDataFrame([(1.0, None, 0.0005), (None, 2.0, 0.03), (3.0, 4.0, 0.9)], "a double, b double, p double")
    got = df.select(
        C.if_else(F.col("a") > 2, "hi", "lo").alias("x"), C.row_mean(["a", "b"]).alias("m"),
        C.stars("p").alias("s"), C.fixed(F.col("p") * 1000).alias("t"),
    ).collect()
    assert [r.x for r in got] == ["lo", None, "hi"]
    assert [r.m for r in got] == [None, None, 3.5]
    assert [r.s for r in got] == ["***", "*", ""]
    assert [r.t for r in got] == ["0.5000", "30.0000", "900.0000"]
    assert df.agg(C.strict_mean("a").alias("m"), C.strict_mean("p").alias("q")).first().m is None


def test_report_file_keeps_newlines(spark, tmp_path):
    from designstats.sources import read_table, write_report

    t = spark.createDataFrame([("a", '1.0"x\n(0.5)'), ("b", "2,0")], "term string, cell string")
    write_report(t, str(tmp_path / "r"))
    back = read_table(spark, str(tmp_path / "r"), "csv", schema="term string, cell string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
