"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and once for the clock; all columns of all rows are computed
(no-op sink). The measured time includes building and planning the query.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans.catalogue import QUERIES  # noqa: E402
from plumbline.session import builder  # noqa: E402

HEADLINE = [
    "normalise_answers", "text_edges", "lexicon_scan", "scene_flags", "assemble_samples", "sample_stats",
    "truncate_at_marker", "transcript_lists", "grade_parse", "grading_lists", "graph_entities",
    "graph_relations", "graph_endpoints", "rule_entities", "rule_relations", "merged_entities", "judge_scores", "relation_hallucination", "probe_scores",
    "batch_inference", "chat_replies", "annotated_turns", "dialogues", "graded_samples",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = (
        builder(f"local[{cpus}]", "plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
