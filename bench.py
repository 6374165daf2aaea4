"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then timed; the value is the sum of the best
timed runs. Results go to the no-op sink, so that all rows are computed and none are
collected. Training and streaming keep state, so they are timed once, uncached.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from feedwatch.operators import model  # noqa: E402
from feedwatch.plans import feeds, messages, registry  # noqa: E402
from feedwatch.sources import derived  # noqa: E402

HEADLINE = [
    "author_stats_top5",
    "poll_new_posts",
    "poll_mark_advance",
    "new_feed_override",
    "insert_if_absent",
    "route_notifications",
    "feedback_state",
    "html_text",
    "tokens",
    "ngram_counts",
    "tfidf_weights",
    "label_with_random",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("feedwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        df = registry.queries()[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        run(name)
        times[name] = min(run(name) for _ in range(runs))

    start = time.perf_counter()
    fitted = model.train(derived.posts(spark, sf_dir))
    times["model_train"] = time.perf_counter() - start
    messages._MODELS[(spark.sparkContext.applicationId, sf_dir)] = fitted
    times["model_scores"] = min(run("model_scores") for _ in range(runs))

    feeds._STREAMS.clear()
    times["stream_ingest"] = run("stream_ingest")

    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
