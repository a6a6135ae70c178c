"""Time the headline queries: one warm-up run, then the median of three, full output computed."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from traceloom.plans.catalog import load  # noqa: E402
from traceloom.session import build_session  # noqa: E402

HEADLINE = [
    "hhi_by_brand_year",
    "edge_support_label",
    "evidence_summary",
    "independent_groups",
    "edge_confidence",
    "source_cap",
    "maker_distribution",
    "tiers",
    "bom_view",
    "resolve_entities",
    "gazetteer_match",
    "content_dedup",
    "quote_exact",
    "passages",
    "event_seq",
    "stagnation",
    "item_projection",
    "graph_diff",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times = {}
    for name in names:
        samples = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "runs": runs,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
