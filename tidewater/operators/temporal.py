"""Frame series: changes, trends, stability, summaries and best frames of videos.

frames: (video_id, frame_idx, overall_score, blue_water_problem_severity, visibility_score).
A window and an aggregate by video share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import half_up
from .select import kept


def _order() -> Window:
    return Window.partitionBy("video_id").orderBy("frame_idx")


def with_diffs(frames: DataFrame) -> DataFrame:
    """Add the ordinal from 0 and the absolute changes since the frame before (null for the first)."""
    w = _order()
    change = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    return frames.withColumns({
        "ordinal": F.row_number().over(w) - 1, "quality_diff": change("overall_score"), "blue_water_diff": change("blue_water_problem_severity"), "visibility_diff": change("visibility_score"),
    })


def slope(y: str, x: str = "ordinal") -> Column:
    """Least-squares slope; null for fewer than two points."""
    return F.try_divide(F.covar_pop(x, y), F.var_pop(x))


def stability(std: Column, mean_diff: Column, n: Column) -> Column:
    """1 for a steady series, down to 0; 1 for fewer than two frames."""
    return F.when(n < 2, F.lit(1.0)).otherwise(1 - F.least(0.5 * std / 100 + 0.5 * mean_diff / 100, F.lit(1.0)))


def temporal_metrics(frames: DataFrame) -> DataFrame:
    """(video_id, analyzed_frames, changes, variances, trends, counts); nulls for fewer than two frames."""
    long = F.count("*") >= 2
    some = lambda c: F.when(long, c)
    good, poor = F.count_if(F.col("overall_score") >= 60), F.count_if(F.col("overall_score") < 40)
    return with_diffs(frames).groupBy("video_id").agg(
        F.count("*").alias("analyzed_frames"),
        some(F.avg("quality_diff")).alias("quality_mean_diff"), some(F.max("quality_diff")).alias("quality_max_diff"),
        some(F.avg("blue_water_diff")).alias("blue_water_mean_diff"), some(F.avg("visibility_diff")).alias("visibility_mean_diff"),
        some(F.var_pop("overall_score")).alias("quality_temporal_variance"), some(F.var_pop("blue_water_problem_severity")).alias("blue_water_temporal_variance"),
        some(slope("overall_score")).alias("quality_trend"), some(slope("blue_water_problem_severity")).alias("blue_water_trend"),
        good.alias("good_frames_count"), poor.alias("poor_frames_count"), (good * 100.0 / F.count("*")).alias("good_frames_percentage"),
        stability(F.stddev_pop("overall_score"), F.avg("quality_diff"), F.count("*")).alias("temporal_stability"),
    )


def video_summary(frames: DataFrame) -> DataFrame:
    """One row per video: scores, spread, stability, trends, percentages, recommendations and warnings."""
    score, severity = "overall_score", "blue_water_problem_severity"
    std = F.stddev_pop(score)
    long = F.count("*") >= 2
    found = with_diffs(frames).groupBy("video_id").agg(
        F.count("*").alias("analyzed_frames"), F.avg(score).alias("average_frame_score"), F.min(score).alias("min_frame_score"), F.max(score).alias("max_frame_score"),
        std.alias("quality_std"), F.avg(severity).alias("blue_water_severity_avg"), F.avg(F.coalesce("visibility_score", F.lit(0.5))).alias("visibility_avg"),
        F.greatest(F.lit(0.0), F.avg(score) - F.least(std / 20, F.lit(1.0)) * 10).alias("overall_video_score"),
        stability(std, F.avg("quality_diff"), F.count("*")).alias("temporal_stability"),
        F.when(long, F.max("quality_diff")).alias("quality_max_diff"), F.when(long, slope(score)).alias("quality_trend"),
        (F.avg((F.col(score) < 20).cast("int")) * 100).alias("very_poor_percentage"), (F.avg((F.col(severity) > 7).cast("int")) * 100).alias("severe_percentage"),
    )
    return found.withColumns({"recommendations": rules.video_recommendations(), "warnings": rules.video_warnings()})


def best_frames(frames: DataFrame, n: int = 10) -> DataFrame:
    """The best n frames of each video with their rank; ties keep the order of the frames."""
    if n <= 0:
        raise ValueError("the number of frames has to be positive")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("overall_score"), "frame_idx"))
    return frames.where(F.col("overall_score").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= n)


def frame_name(fps: float | Column = 30.0) -> Column:
    """The file name of an exported frame."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    return F.format_string("frame_%06d_quality_%.1f_t%.2fs.jpg", F.col("frame_idx"), half_up("overall_score", 1), half_up(F.col("frame_idx") / rate, 2))


def timeline(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video_id, frame_idx, t, score, severity, visibility of 100)."""
    rate = fps if fps > 0 else 30.0
    return frames.select("video_id", "frame_idx", (F.col("frame_idx") / rate).alias("t"), F.col("overall_score").alias("score"), F.col("blue_water_problem_severity").alias("severity"), (F.col("visibility_score") * 100).alias("visibility"))


def filter_frames(frames: DataFrame, threshold: float = 40.0, fps: float = 30.0) -> DataFrame:
    """The filter's record of each frame; one that could not be scored counts as 50, severity 0, Unknown."""
    score = F.coalesce("overall_score", F.lit(50.0))
    return frames.select(
        "video_id", F.col("frame_idx").alias("frame"), half_up(F.col("frame_idx") / (fps if fps > 0 else 30.0), 2).alias("time_s"), half_up(score, 2).alias("overall_score"),
        half_up(F.coalesce("blue_water_problem_severity", F.lit(0.0)), 2).alias("blue_water_severity"),
        F.when(F.col("overall_score").isNull(), "Unknown").otherwise(F.col("usability_category")).alias("usability"), kept("overall_score", threshold).alias("kept"),
    )


def filter_summary(frames: DataFrame, threshold: float = 40.0) -> DataFrame:
    """(video_id, total, kept, removed, percentage, least, largest, means) of the filter."""
    score, stays = F.coalesce("overall_score", F.lit(50.0)), kept("overall_score", threshold)
    return frames.groupBy("video_id").agg(
        F.count("*").alias("total_frames"), F.count_if(stays).alias("frames_kept"), F.count_if(~stays).alias("frames_removed"), (F.count_if(stays) * 100.0 / F.count("*")).alias("kept_percentage"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.avg(F.when(stays, score)).alias("mean_kept_score"),
    )
