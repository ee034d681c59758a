"""Headline queries on BENCH_SF_DIR (default sf0.1) with local[BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from designstats.plans import catalog  # noqa: E402
from designstats.plans.registry import forget  # noqa: E402
from designstats.session import local_session, sf_name  # noqa: E402

HEADLINE = [
    "g01_survey_count", "g08_grouped_mean", "g09_many_means", "g12_survey_var", "g15_survey_quantile",
    "h01_brr_mean", "h04_jkn_mean", "h07_jkn_grouped_mean", "h05_bootstrap_mean", "h09_replicate_vcov",
    "i05_rao_scott_second", "j04_survey_linear_interactions", "j07_survey_logit_interactions",
    "j11_survey_poisson_interactions", "j09_survey_ordinal_score", "j13_survey_negbin_terms",
    "j15_survey_multinomial_score", "j16_multinomial_bootstrap", "k10_predict_whole_table",
    "l02_moment_covariance", "l04_path_model", "m03_imputation_invariants", "n01_rescaled_weights",
    "n05_mixed_mi_n", "n07_mixed_mis_a", "o02_matching", "o07_ate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the session
    seconds = {}
    for name in names:
        forget(spark)  # every query is timed cold
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_name(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
