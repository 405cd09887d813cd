"""The data behind each chart; drawing is left to other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import c, clip, score_colour, severity_colour
from .pixels import histogram, lab_columns


def channel_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, v, n, height): counts of values, and as a part of the channel's largest count."""
    counts = histogram(pixels, {n: F.col(n) for n in "bgr"}).drop("total")
    tallest = counts.groupBy("image_id", "channel").agg(F.max("n").alias("most"))
    return counts.join(tallest, ["image_id", "channel"]).select("image_id", "channel", "v", "n", (F.col("n") / F.col("most")).alias("height"))


def _bars(bars: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("bar"), v.cast("double").alias("height")) for k, v in bars.items()])).alias("b")


def bars(metrics: DataFrame, panel: str, key: str = "path") -> DataFrame:
    """(key, bar, height) of a panel of bars."""
    full = lambda n, top: clip(c(n) / top) * 100
    panels: dict[str, dict[str, Column]] = {
        "scores": {"overall": c("overall_score"), "features": c("feature_usefulness_score"), "science": c("marine_science_value")},
        "channels": {"blue": c("blue_channel_mean"), "green": c("green_channel_mean"), "red": c("red_channel_mean")},
        "blue_water": {"severity": c("blue_water_severity") * 100, "turbidity": c("turbidity_score") * 100, "temperature": full("color_temperature", 3), "dominance": (c("blue_dominance") + 0.5) * 100},
        "contrast": {"rms": c("rms_contrast") * 100, "michelson": c("michelson_contrast") * 100, "local": full("local_contrast", 50), "gradient": full("sharpness_gradient", 30)},
        "features": {"edges": c("edge_density") * 500, "corners": c("corner_density") * 10000, "keypoints": c("keypoint_density") * 10, "texture": c("texture_complexity") / 2},
        "underwater": {"uciqe": c("uciqe_score") * 100, "uiqm": full("uiqm_score", 3), "visibility": c("visibility_score") * 100, "clarity": (1 - c("turbidity_score")) * 100},
        "gauges": {"features": c("feature_usefulness_score"), "science": c("marine_science_value"), "clarity": (1 - c("turbidity_score")) * 100},
    }
    if panel not in panels:
        raise ValueError(f"panels are {', '.join(panels)}")
    return metrics.select(key, _bars(panels[panel])).select(key, "b.bar", "b.height")


def overlay(metrics: DataFrame, key: str = "path") -> DataFrame:
    """What stands over the image: score, category and their colours."""
    return metrics.select(key, "overall_score", "usability_category", score_colour().alias("score_colour"), severity_colour().alias("severity_colour"), (c("blue_water_severity") > 0.5).alias("blue_flag"))


def lab_scatter(pixels: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """About n pixels of each image as (image_id, y, x, lab_l, lab_a, lab_b); the plot is a sample by design."""
    totals = pixels.groupBy("image_id").agg(F.count("*").alias("total"))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "image_id", "y", "x"), F.col("total")) < n
    return pixels.join(totals, "image_id").where(chosen).withColumns(lab_columns()).select("image_id", "y", "x", "lab_l", "lab_a", "lab_b")


def training_curve(history: DataFrame) -> DataFrame:
    """(epoch, train_loss, val_loss, val_mae, learning_rate, best): best marks the epoch of the least validation loss."""
    best = history.agg(F.min(F.struct("val_loss", "epoch")).alias("m")).select(F.col("m.epoch").alias("_best"))
    return history.crossJoin(F.broadcast(best)).select("epoch", "train_loss", "val_loss", "val_mae", "learning_rate", (F.col("epoch") == F.col("_best")).alias("best"))
