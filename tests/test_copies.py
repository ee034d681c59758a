"""Completed copies are not kept or moved whole."""

from designstats.plans import q_structures


def test_copies_are_read_again_and_counted_by_value_before_the_donors(spark):
    sf = "/root/testdata/sf0.001"
    plan = q_structures.m03(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not q_structures._imputed(spark, sf).storageLevel.useDisk
    joined = plan[plan.index("Join LeftOuter"):].splitlines()[1:3]
    assert any("Aggregate [__imp" in line for line in joined)
