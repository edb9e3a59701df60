"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES
from inkwitness.session import local_session

HEADLINE = [
    "scan_risk", "detect_prompt_injection", "detect_overlaps", "detect_image_only", "page_word_order", "clean_spans", "inspect_spans",
    "ai_score", "paragraph_ai_scores", "match_job", "extract_skills", "all_pairs_cosine", "duplicate_pairs", "dedupe_by_content",
    "coalesce_char_runs", "history_summary", "scan_results",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    QUERIES["history_total"](spark, folder).collect()  # start-up is not a query
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
