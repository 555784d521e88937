"""Time the headline queries over whole tables and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma list, default all headline queries).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "positive_share_by_form", "label_price_change", "membership_asof", "ticker_first_match", "json_series_parse",
    "clean_filing", "split_sentences", "meaningful_sentences", "word_count", "words_per_line_hist",
    "pack_compat", "pack_lossless", "exact_split", "stratified_folds", "contiguous_folds", "balance_classes",
    "split_replay", "finetune_set", "encode_examples", "wordpiece", "subtoken_runs", "mlm_instances",
    "pool_mean_std", "standardize", "nb_predict", "knn_predict", "nb_learning_curve", "knn_validation_curve",
    "class_report", "roc_points", "auc", "company_direction_counts", "company_drift", "knn_learning_curve", "oov_rate", "mlm_pairs",
    "pca_points", "embed_hook", "svm_rff", "rff_lift", "svm_margin", "stream_clean", "stream_prices", "stream_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)

    from disclosure_spark.plans.queries import QUERIES
    from disclosure_spark.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # an untimed pass compiles code and fills caches
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
