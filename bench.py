"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from depvital.plans.fixtures import SNAPSHOTS, Fixtures
from depvital.plans.queries import QUERIES
from depvital.session import build_session

HEADLINE = (
    "label_distribution",
    "lifecycle_scan",
    "release_slots",
    "advisory_metrics",
    "transitive_advisories",
    "registry_eol",
    "reachability",
    "graph_metrics",
    "diet_plan",
    "diet_from_sources",
    "eol_text_readme",
    "license_mentions",
    "license_report",
    "coupling_metrics",
    "sbom_direct",
    "action_closure",
    "package_keys",
    "project_scan",
)
# queries over whole documents, for rates in documents per second
PER_DOCUMENT = ("eol_text_readme", "license_mentions")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    started = time.time()
    fixtures = Fixtures(spark, sf_dir)
    for name in SNAPSHOTS:  # the fact tables that the queries read
        fixtures[name]
    set_up = round(time.time() - started, 3)
    fixtures["documents"].selectExpr("max(length(text))").collect()  # code that every query shares is compiled by now
    for name in names:
        started = time.time()
        QUERIES[name](Fixtures(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    documents = fixtures["documents"].count()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "set_up_seconds": set_up,
        "documents_per_second": {n: round(documents / seconds[n], 1) for n in PER_DOCUMENT if n in seconds},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
