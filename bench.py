"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "dataset_stats", "traj_length", "filter_speed", "tessellate_square", "simple_generalization_all", "simple_generalization_one", "tile_sequences", "combination_support",
    "bad_combinations", "pair_support", "suppress_rare_pairs", "swap_candidates", "quadtree_cells", "quadtree_heatmap_nomerge", "uncorrelated_location_entropy", "mean_square_displacement",
    "mean_trajectory", "martinez_distance", "rsme", "trajectories_removed", "microaggregation_by_start"
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tracewarden.plans.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the executors
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1])}))


if __name__ == "__main__":
    main()
