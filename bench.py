"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads, BENCH_RUNS the timed runs of each
query (their median counts, after one warm-up), BENCH_ONLY a comma list of name parts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from voxlake.catalog import all_queries
from voxlake.session import local_session, ship_by_value

HEADLINE = [
    "b04_dashboard_summary",
    "b11_phase_chain",
    "b14_synthesis_plan",
    "c01_enrich_tasks",
    "c05_edits_merge_first",
    "c08_merge_edits",
    "c10_slice_samples",
    "d01_workflow_progress",
    "d02_speaker_stats",
    "d04_series_quality",
    "d05_concat_text",
    "d08_silhouette",
    "e01_select_reference",
    "e02_speaker_turns",
    "e03_speech_segments",
    "e05_pack_blocks",
    "e07_assign_batches",
    "e10_moving_power",
    "e13_resample_up",
    "e14_overlay_add",
    "e16_mix_with_background",
    "e17_peak_speech_track",
    "f02_next_step",
    "h01_clean_text",
    "h02_pack_sentences",
    "i02_apply_step_updates",
    "i03_apply_commands",
    "i05_latest_progress",
    "j01_score_keep_input",
    "j04_cluster_speakers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    ship_by_value()
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in [n for n in (queries if only == ["all"] else HEADLINE) if not only or only == ["all"] or any(p in n for p in only)]:
        taken = []
        for attempt in range(runs + 1):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt or runs == 0:
                taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total seconds of the headline queries, median of warm runs", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
