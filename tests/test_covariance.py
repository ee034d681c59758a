"""Design covariance of totals: one pass over the PSU totals, whatever the lonely policy."""

import numpy as np
import pytest

from designstats.operators.design import PSU, STR, Design
from designstats.operators.fitting import total_covariance


@pytest.mark.parametrize("lonely", ["remove", "adjust", "average"])
def test_covariance_reads_psu_totals_once(spark, lonely):
    r = np.random.default_rng(3)
    rows = [(s, f"{s}{i}", *r.normal(size=2).tolist()) for s, n in (("a", 5), ("b", 1), ("c", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, p string, t double, u double")
    d = Design.of(df, "p", "s", lonely=lonely)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    psu = d.df.select(STR, PSU, "t", "u").mapInPandas(counted, f"{STR} string, {PSU} string, t double, u double")
    got = total_covariance(d, psu, ["t", "u"])
    want = np.zeros((2, 2))
    for s in "abc":
        x = np.array([row[2:] for row in rows if row[0] == s])
        if len(x) > 1:
            want += len(x) * np.cov(x.T)
        elif lonely == "adjust":
            want += x.T @ x
    assert np.allclose(got, want * (3 / 2 if lonely == "average" else 1))
    assert read.value == len(rows)
