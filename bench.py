"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "colour_cast", "global_contrast", "lab_uciqe", "histogram_distribution", "sharpness", "canny_edge_density", "fast_keypoints", "tile_assessment", "overall_score", "recommendations",
    "batch_summary", "ranking", "temporal_metrics", "video_summary", "best_frames", "hybrid_blend", "csv_projection",
)
#: Timed as well, but not part of the total, which is of the same queries each round.
MORE = ("low_quality", "top_10", "severe_blue_water", "score_spread", "local_contrast", "tiled_metrics", "video_scan")


def main() -> None:
    from pyspark.sql import SparkSession

    from tidewater.operators.assess import assess
    from tidewater.plans.queries import QUERIES
    from tidewater.sources.synthetic import synthetic_images

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(QUERIES["colour_cast"](spark, SF_DIR))  # warm-up
    took = {}
    for name in HEADLINE + MORE:
        t = time.time()
        sink(QUERIES[name](spark, SF_DIR))
        took[name] = round(time.time() - t, 3)
    rate = {}
    for n in (64, 256):  # the start of the Python workers weighs less in the longer run
        images = synthetic_images(spark, n, 720).repartition(int(CPUS)).persist()
        images.count()
        t = time.time()
        sink(assess(images.drop("quality_score", "blue_water_severity")))
        rate[n] = round(n / (time.time() - t), 2)
        images.unpersist()
    total = round(sum(took[name] for name in HEADLINE), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("/sf", 1)[-1], "images_per_sec_720x720": rate[64], "images_per_sec_720x720_of_256": rate[256]}))
    spark.stop()


if __name__ == "__main__":
    main()
