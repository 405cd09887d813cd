"""Recommendations and warnings: ordered predicates over metric columns, as arrays of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import c, half_up

Rule = tuple[Column, Column | str]


def fired(rules: list[Rule], default: str | None = None) -> Column:
    """The texts of the rules that hold, in order; the default alone if none does."""
    texts = F.array_compact(F.array(*[F.when(p, text if isinstance(text, Column) else F.lit(text)) for p, text in rules]))
    return texts if default is None else F.when(F.size(texts) == 0, F.array(F.lit(default))).otherwise(texts)


def recommendations() -> Column:
    cast = c("blue_water_severity")
    return fired([
        (cast > 0.7, "Severe blue cast: correct the white balance and restore the red channel"),
        ((cast > 0.5) & (cast <= 0.7), "Moderate blue-green cast: apply colour correction"),
        (c("rms_contrast") < 0.2, "Low contrast: equalise locally or adjust gamma"),
        (c("blur_estimate") > 0.6, "Blurred: sharpen, and check focus and motion"),
        (c("turbidity_score") > 0.7, "Turbid: capture in clearer water"),
        (c("edge_density") < 0.05, "Few features: check distance and clarity"),
        (c("visibility_score") < 0.3, "Poor visibility: add light or move closer"),
        (c("sharpness_laplacian") < 100, "Soft: sharpen or lock the focus"),
        (c("hue_diversity") < 3.0, "Few hues: restore colours"),
        (c("feature_usefulness_score") > 70, "Good for computer vision"),
        (c("marine_science_value") > 70, "Good for marine science"),
    ], "Adequate for basic analysis")


def warnings() -> Column:
    return fired([
        (c("feature_usefulness_score") < 20, "CRITICAL: hardly any features"),
        (c("marine_science_value") < 20, "CRITICAL: hardly any scientific value"),
        (c("blue_water_severity") > 0.7, "CRITICAL: severe blue cast"),
        (c("visibility_score") < 0.2, "CRITICAL: extremely poor visibility"),
        (c("turbidity_score") > 0.75, "HIGH: very turbid"),
        (c("michelson_contrast") < 0.2, "HIGH: very low contrast"),
        (c("edge_density") < 0.03, "HIGH: hardly any edges"),
        (c("blur_estimate") > 0.7, "MEDIUM: strong blur"),
        (c("keypoint_density") < 0.5, "MEDIUM: few keypoints"),
        (c("entropy_gray") < 4.0, "MEDIUM: little information"),
        (c("blue_dominance") > 0.3, "Blue dominates: reds are attenuated"),
        (c("color_temperature") > 2.0, "Blue-shifted: warm colours are reduced"),
    ])


def video_recommendations() -> Column:
    """Over the columns of a video summary; one text if no frame was assessed."""
    mean, trend = c("average_frame_score"), c("quality_trend")
    found = fired([
        (c("quality_std") > 20, F.format_string("High variability (std %.1f): stabilise the camera or the light", half_up("quality_std", 1))),
        (c("temporal_stability") < 0.5, F.format_string("Low temporal stability (%.2f): quality changes fast between frames", half_up("temporal_stability", 2))),
        (mean < 40, F.format_string("Poor average quality (%.1f): capture again", half_up("average_frame_score", 1))),
        (mean > 70, F.format_string("Good average quality (%.1f)", half_up("average_frame_score", 1))),
        (c("blue_water_severity_avg") > 7, F.format_string("Severe blue water (%.1f of 10): correct colours", half_up("blue_water_severity_avg", 1))),
        (trend < -0.5, "Declining quality: turbidity or light may change"),
        (trend > 0.5, "Improving quality: early frames are less useful"),
    ])
    return F.when(c("analyzed_frames") == 0, F.array(F.lit("No frame could be analysed"))).otherwise(found)


def video_warnings() -> Column:
    poor, blue = c("very_poor_percentage"), c("severe_percentage")
    found = fired([
        (poor > 50, F.format_string("CRITICAL: %.1f%% of the frames are very poor", half_up("very_poor_percentage", 1))),
        ((poor > 25) & (poor <= 50), F.format_string("HIGH: %.1f%% of the frames are poor", half_up("very_poor_percentage", 1))),
        (c("quality_max_diff") > 40, F.format_string("HIGH: abrupt quality changes (%.1f)", half_up("quality_max_diff", 1))),
        (blue > 30, F.format_string("HIGH: %.1f%% of the frames have severe blue water", half_up("severe_percentage", 1))),
    ])
    return F.when(c("analyzed_frames") == 0, F.array(F.lit("CRITICAL: no frame could be analysed"))).otherwise(found)
