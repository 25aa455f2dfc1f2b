"""Headline-query benchmark: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full through the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pliego.operators.report import study  # noqa: E402
from pliego.plans import registry  # noqa: E402
from pliego.plans.contract_view import contract_view  # noqa: E402
from pliego.session import build_session  # noqa: E402

HEADLINE = [
    "distribution_modality",       # distribution with share of total
    "demand_distributions",        # five dimensions in one pass
    "describe_values_events",      # grouped descriptive statistics
    "study_per_region",            # stats + IQR outliers + adjusted stats per segment
    "keyword_filter_documents",    # accent-blind keyword AND search over whole texts
    "clean_results",               # text normalization + money/date parsing
    "upsert_last_event_per_user",  # keyed keep-last merge
    "resolve_catalog_departments", # tiered catalog resolution
    "annex_top50",                 # top-k annex with formatting
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), app_name="pliego-bench")
    registry.load_all()
    # Warm-up (not timed): JIT, Python workers and the codegen cache, by
    # running every headline query once on the smallest tables.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            run(registry.QUERIES[name](spark, warm_dir))
        for df in study(contract_view(spark, warm_dir, spread_scan=True)).values():
            run(df)
    else:
        run(registry.QUERIES["demand_totals"](spark, sf_dir))
    timings: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(registry.QUERIES[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    # spread_scan: the local file is one row group; the private session leaves constraint propagation off
    cv = contract_view(spark, sf_dir, spread_scan=True)
    sections = study(cv)
    for df in sections.values():
        run(df)
    timings["complete_study"] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
