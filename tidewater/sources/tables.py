"""The star-schema tables as images, frames and scores, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tiles that one group of suppliers may fill; it keeps the tiles' numbers apart.
MOST_TILES = 1_000_000


def tiles(spark: SparkSession, sf_dir: str, side: int = 27, suppliers: int = 1) -> DataFrame:
    """Pixel rows (image_id, y, x, b, g, r): the line items of each group of suppliers fill tiles of side * side pixels.

    Every line item is a pixel; the rest of a group's last tile is black.
    """
    size = side * side
    rows = table(spark, sf_dir, "lineitem").withColumn("group", F.floor(F.col("l_suppkey") / suppliers).cast("long"))
    placed = rows.withColumn("n", (F.row_number().over(Window.partitionBy("group").orderBy("l_suppkey", *LINE_ORDER)) - 1).cast("long"))
    shown = placed.select("group", "n", (F.col("l_partkey") % 256).cast("int").alias("b"), (F.col("l_orderkey") * 7 % 256).cast("int").alias("g"), (F.col("l_quantity") * 5).cast("int").alias("r"))
    counts = rows.groupBy("group").agg(F.count("*").alias("whole")).where(F.col("whole") % size != 0)
    last = (F.floor(F.col("whole") / size) + 1) * size - 1
    black = counts.select("group", F.explode(F.sequence("whole", last)).alias("n"), *[F.lit(0).alias(c) for c in "bgr"])
    return shown.unionByName(black).select(
        (F.col("group") * MOST_TILES + F.floor(F.col("n") / size)).alias("image_id"), F.floor(F.col("n") % size / side).cast("int").alias("y"), (F.col("n") % side).cast("int").alias("x"), "b", "g", "r",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame series from the events: a user is a video, time gives the order, the value the score."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "ts", F.least(F.lit(100.0), "value").alias("overall_score"))
    rows = rows.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("video_id").orderBy("ts")) - 1).cast("long"))
    return rows.select("video_id", "frame_idx", "overall_score", (10 - F.col("overall_score") / 10).alias("blue_water_problem_severity"), (F.col("overall_score") / 200 + 0.25).alias("visibility_score"))


#: Metric columns from order keys: name, multiplier, modulus, divisor, offset.
METRIC_COLUMNS = (
    ("blue_channel_mean", 37, 256, 1.0, 0.0), ("green_channel_mean", 53, 256, 1.0, 0.0), ("red_channel_mean", 71, 256, 1.0, 1.0),
    ("rms_contrast", 31, 100, 140.0, 0.0), ("michelson_contrast", 17, 100, 100.0, 0.0), ("sharpness_gradient", 13, 90, 2.0, 0.0),
    ("sharpness_laplacian", 19, 400, 1.0, 0.0), ("edge_density", 29, 100, 400.0, 0.0), ("keypoint_density", 23, 100, 40.0, 0.0),
    ("entropy_gray", 41, 80, 10.0, 0.0), ("blur_estimate", 43, 100, 100.0, 0.0), ("uciqe_score", 47, 100, 140.0, 0.0),
    ("uiqm_score", 59, 100, 30.0, 0.0), ("hue_diversity", 61, 70, 10.0, 0.0), ("local_contrast", 67, 60, 1.0, 0.0),
)


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, customer, base metrics, error): every order as an assessed image, every 97th as a failed one."""
    key = F.col("o_orderkey")
    failed = key % 97 == 0
    cols = [F.when(~failed, (key * m % k) / d + o).alias(n) for n, m, k, d, o in METRIC_COLUMNS]
    path = F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string"), F.lit("/img"), key.cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "orders").select(path.alias("path"), F.col("o_custkey").alias("customer"), *cols, F.when(failed, "failed").alias("error"))
