"""Headline benchmark: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from celstack.plans import load  # noqa: E402
from celstack.session import local_session  # noqa: E402

HEADLINE = (
    "suitability_decision", "mask_dilate", "mask_feather", "composite_over", "source_protection", "front_winner", "neutral_fidelity", "components4",
    "unresolved_references", "ontology_gaps", "report_status", "content_dedupe", "panel_projection", "run_rollup", "owned_results", "evaluate_experiments",
    "frame_sequence", "foldover_check", "tracking_state", "stream_late_results",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    registry = load()
    spark = local_session(cpus, memory="12g", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry["report_status"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
