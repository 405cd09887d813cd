"""Assessing images as they arrive, and watching scores over time (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assess import assess


def arriving_images(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of image rows from a landing folder."""
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = spark.readStream.format("image").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    bad = F.col("image.nChannels") <= 0
    value = lambda c: F.when(~bad, F.col(f"image.{c}"))
    return rows.select(F.col("image.origin").alias("path"), value("height").alias("height"), value("width").alias("width"), value("nChannels").alias("channels"), value("data").alias("data"), F.when(bad, "the file can't be decoded").alias("error"))


def assess_stream(images: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:  # noqa: ANN003
    """Append assessments of all that has arrived to a Parquet folder; restarts go on from the checkpoint."""
    writer = assess(images, **options).drop("custom").writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("path", out).option("checkpointLocation", checkpoint).start()


def windowed_scores(scores: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Mean, least and number of scores by time window; rows later than the watermark are left out of a stream."""
    timed = scores.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window)).agg(F.count("*").alias("n"), F.avg("overall_score").alias("mean_score"), F.min("overall_score").alias("min_score")).select(F.col("window.start").alias("start"), "n", "mean_score", "min_score")
