"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1) and BENCH_CPUS the
local cores.  Each query is built and written to a sink that keeps no rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    # Level building: what the one published number of the domain measures.
    "levels_profile", "l1_adi_levels", "u3_l2_ados_levels", "l3_mullen_levels", "l4_vineland_levels", "l5_srs_levels",
    "g3_level_tables",
    # Cohort, views, counts.
    "s1_select_phenotype", "d2_cross_section", "d9_longitudinal", "j4_wide_inner", "g5_combination_counts",
    "j8_cooccurrence", "i1_prepare_imputation", "f11_quantiles",
    # Neighbours, statistics, stability.
    "i5_knn_impute", "v3_knn_classify", "v14_distance_summary", "t5_pairwise_t", "g12_boxplots", "v9_choose_k",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else 8,
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
