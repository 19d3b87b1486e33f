"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

from tidemark import catalog
from tidemark.session import local_session

HEADLINE = ["region_quarter", "rollup_grouping_sets", "partner_quarter_facts", "partner_snapshot", "feature_snapshot", "kpis_region_filter",
            "trend_quarter_region", "breakdown_region", "churn_noise", "revenue_concentration", "forecast_methods", "routing_policies",
            "decide_with_cap", "word_documents"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidemark-bench")
    reg = catalog.load()
    reg["region_quarter"].fn(spark, sf_dir).limit(1).collect()  # start the JVM and load classes
    times = {}
    for name in HEADLINE:
        t = time.time()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
