"""Time the headline queries and print one JSON line.

Every query starts from the stored tables; results shared between queries are
dropped before each run, so each time covers the query's whole work. Output
rows go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tengen.plans.queries import REGISTRY  # noqa: E402
from tengen.session import build_session  # noqa: E402
from tengen.sources.fixtures import Fixtures  # noqa: E402

HEADLINE = [
    "player_history", "index_coverage", "player_schedule", "h2h_games", "h2h_summary", "promotion_candidates",
    "round_progress", "standings", "scenario_rank_distribution", "event_live_rollup", "player_strength",
    "basic_strength", "promotion_history", "norm_participants", "latest_events", "clean_text",
    "extract_anchor_groups", "h2h_candidates", "later_group_inference", "replace_participants", "replace_matches",
    "stream_live_records_table", "stream_standings",
]
# stored tables the headline queries read
TABLES = ["events", "groups", "participants", "matches", "match_status", "index_status", "notices",
          "confirmed_rules", "evidence", "live_groups", "scenarios", "pair_requests", "event_updates",
          "event_pages", "payload_participants", "payload_matches"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(REGISTRY)
    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=max(8, n),
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    fx = Fixtures.of(spark, sf_dir)
    t = time.time()
    for name in TABLES:
        fx.table(name)
    tables = round(time.time() - t, 2)
    times: dict[str, float] = {}
    for name in names:
        fx.forget_shared()
        t = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "table_build_sec": tables}))
    spark.stop()


if __name__ == "__main__":
    main()
