"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, default all).
Every query is run to its full result (noop sink), once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldgrain.plans import load_queries  # noqa: E402
from fieldgrain.session import build_session  # noqa: E402

# One query per stage of the work: coverage, metrics, splits, selection, curves, spectra, maps, planning, fits.
HEADLINE = [
    "coverage_deficits", "coverage_report_counts", "requested_vs_achieved", "difficulty_rank", "deficit_requests",
    "metrics_partition", "metrics_sets", "metrics_run", "errors_by_group", "outlier_flags", "hotspot_controls", "weighted_median",
    "association", "binned_trend", "mutual_information", "roc_pr_auc", "accuracy_coverage",
    "split_grouped", "split_folds", "split_integrity", "balanced_selection", "balanced_weights", "patch_quota",
    "ecum_curve", "quantile_to_k", "ecum_shape", "peaks_two_component", "radial_features",
    "patch_members", "patch_truth", "patch_purity", "radial_power", "patch_features",
    "map_gradient", "map_fill", "map_edge_aware", "map_upsample", "graph_smoothing",
    "run_inventory", "ledger_merge", "metadata_attach", "dataset_summary",
    "ridge", "out_of_fold", "bagged_trees", "predicted_speed_maps", "directed_centers", "stream_coverage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_queries()
    for name in ("field_class", "global_spectrum"):  # start the JVM and the Python workers
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        start = time.time()
        try:
            queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # report the rest
            failed[name] = str(error)[:200]
    windows = 16 * spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    out = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "windows": windows,
        "windows_per_second": round(windows / times["patch_features"], 1) if "patch_features" in times else None,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
