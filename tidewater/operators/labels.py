"""Labels: joining them with files, and exporting them for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = "map<string,struct<quality_score:double,blue_water_severity:double,feature_usefulness:double>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, quality_score, blue_water_severity, feature_usefulness) of a JSON object of labels."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", LABELS)).alias("filename", "label"))
    return rows.select("filename", "label.*")


def with_defaults(labels: DataFrame) -> DataFrame:
    return labels.withColumns({"quality_score": F.coalesce("quality_score", F.lit(50.0)), "blue_water_severity": F.coalesce("blue_water_severity", F.lit(5.0))})


def labelled(labels: DataFrame, files: DataFrame, on: str = "filename") -> DataFrame:
    """Labels whose file exists."""
    return labels.join(files.select(on), on, "left_semi")


def missing(labels: DataFrame, files: DataFrame, on: str = "filename") -> DataFrame:
    """Labels without a file."""
    return labels.join(files.select(on), on, "left_anti")


def basename(path: Column | str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def training_labels(results: DataFrame, order: str = "path", feature: bool = True) -> DataFrame:
    """(filename, quality_score, blue_water_severity[, feature_usefulness]) of valid results; of equal names the last stays."""
    rows = results.where("error is null and overall_score is not null").withColumn("filename", basename(order))
    w = Window.partitionBy("filename").orderBy(F.desc(order))
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    extra = [F.col("feature_usefulness_score").alias("feature_usefulness")] if feature else []
    return last.select("filename", F.col("overall_score").alias("quality_score"), F.coalesce("blue_water_problem_severity", F.lit(5.0)).alias("blue_water_severity"), *extra)


def label_lines(labels: DataFrame) -> DataFrame:
    """One JSON object per label (value), to be written as text."""
    return labels.select(F.to_json(F.struct(*labels.columns)).alias("value"))
