"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pit1_append_revisions", "pit2_bars_as_of", "pit3_bars_as_of_many", "pit9_resolve_instruments", "prj2_admit_bars", "wn16_feature_panel_every_row", "wn16_feature_panel_latest",
    "sm5_episodes", "sm6_screen", "sl1_rank_by_feature", "sm1_positions", "ag1_session_health", "ag6_research_summary", "sm17_resolve_horizons", "sm18_evaluate_outcomes", "sm23_verify_decisions",
    "sm12_evidence_as_of", "src1_read_provider_bars",
)


def main() -> None:
    from tidemark.plans import load_all
    from tidemark.plans.registry import QUERIES
    from tidemark.session import build_session

    load_all()
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
