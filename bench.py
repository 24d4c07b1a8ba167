"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores and
``BENCH_QUERIES`` (optional, comma-separated) a choice of queries. Each query is written to a
sink that drops its rows; the faster of two runs counts (one run for the heaviest).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wicara.catalog import QUERIES  # noqa: E402
from wicara.session import build_session  # noqa: E402

HEADLINE = (
    "binary_metrics_by_lang",
    "clean_text_ascii",
    "clean_text_unicode",
    "slang_normalize",
    "remove_stopwords",
    "stem_by_dictionary",
    "preprocess_pipeline",
    "lexicon_rule",
    "lexicon_matches_joined",
    "toxicity_meter",
    "gambling_report",
    "dedup_keep_first",
    "duplicate_rows",
    "conflict_free_rows",
    "labels_per_text",
    "column_profile",
    "exact_split",
    "stratified_group_folds",
    "tfidf_vocabulary",
    "tfidf_weights",
    "vocabulary_coverage",
    "macro_metrics",
    "feed_stream",
    "lexicon_rule_large",
    "stem_tokens",
    "balanced_group_folds",
    "sparse_labels",
    "repeated_posts",
)
# Run once: these fit models.
HEAVY = ("mood_head", "svm_scores", "calibrated_confidence", "trimodel_scores")


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE + HEAVY
    spark = build_session(
        "wicara-bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="16g",
        spark_wicara_inputPartitions=cpus,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, folder, "value_counts")
    seconds = {name: round(min(run(spark, folder, name) for _ in range(1 if name in HEAVY else 2)), 3) for name in chosen}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
