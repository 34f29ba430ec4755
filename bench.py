"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from typelore.plans.registry import QUERIES
from typelore.session import build_session, scratch

HEADLINE = (
    "count_by_type",
    "merge_users",
    "merge_comments",
    "flatten_threads",
    "hot_top_n",
    "extract_all",
    "person_features",
    "summary",
    "word_occurrences",
    "remove_rare_words",
    "tfidf",
    "term_group_correlation",
    "top_terms",
    "tidy_comment",
    "embed",
    "pairwise_inner",
    "pairwise_top_k",
    "flatten_nested",
    "dichotomy_stats",
    "lemmatize",
    "tfidf_per_person",
    "stats_and_tokens_per_letter",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # starts the engine
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(1 + RUNS):  # the first run loads classes and is not counted
            started = time.perf_counter()
            with scratch(spark):
                # every row is computed, none is sent to the driver
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(took[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
