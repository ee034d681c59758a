"""A cross-section of the registered queries against their SQL twin.

``python tests/oracle.py`` runs all of them.
"""

import pytest

from designstats.plans import catalog
from oracle import compare, connect

SF = "/root/testdata/sf0.01"
NAMES = [
    "a04_report_csv", "b13_centre_weighted", "b22_cut_stars", "cf02_domain_keeps_psus", "d08_to_wide_values",
    "e10_quantiles", "f04_lonely_average", "g03_grouped_count_share", "g05_survey_mean", "g08_grouped_mean",
    "g12_survey_var", "g15_survey_quantile", "h01_brr_mean", "h04_jkn_mean", "h05_bootstrap_mean", "i02_wald",
    "i05_rao_scott_second", "j07_survey_logit", "j09_survey_ordinal", "j15_survey_multinomial",
    "j21_wald_terms", "k01_predict_link", "l02_moment_covariance", "l05_indirect_effect", "m03_imputation_invariants",
    "n01_rescaled_weights", "n05_mixed_m0_n", "o02_matching", "o07_ate", "p01_wrap_cell",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, message


def test_registry_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 180
