"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkmark.plans.registry import all_queries  # noqa: E402
from inkmark.session import local_session  # noqa: E402

HEADLINE = (
    "detector_report dedup_exact clean_strict audit_cleaning audit_metadata_leakage text_dedup_key stylo_v2 stylo_v1 "
    "tfidf_word tfidf_vocab near_dup_cosine split_stratified split_grouped split_generator_holdout metrics_auc "
    "metrics_slices stream_dedup train_m1"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["scan_bounded"](spark, sf_dir).collect()  # start the JVM and its executors
    seconds = {}
    for name in names:
        start = time.time()
        # every row and column is computed, none is sent to the driver
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
