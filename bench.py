"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ALL=1 for every query.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from noisefleet.plans import registry  # noqa: E402
from noisefleet.session import local_session  # noqa: E402

HEADLINE = (
    "laeq_by_site", "exceedance", "energy_concentration", "ldn_lden", "channel_stats", "data_quality", "trend", "peaks",
    "daily_summary", "hourly_summary", "heatmap_hour_date", "hourly_box", "rolling_median", "laeq_1min", "modal_interval",
    "gaps", "gap_summary", "merge_dedupe", "noise_events", "top_events", "fold_mark", "clock_convert", "filter_exclusions",
    "wx_minute_states", "wx_blocks", "wx_apply", "nearest_stations", "compliance_matrix", "compare_sites", "ts_parse",
    "ts_expand_ties",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    # the first query pays for starting the JVM and compiling; it is not timed
    queries["ldn_lden"](spark, sf_dir).collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": pathlib.Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
