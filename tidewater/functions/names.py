"""Names and result schemas of the image metrics."""

from __future__ import annotations

from pyspark.sql import types as T

#: The 37 metrics in their fixed order (fixed values).
METRIC_NAMES = (
    "blue_channel_mean", "green_channel_mean", "red_channel_mean", "blue_dominance",
    "green_dominance", "blue_green_ratio", "blue_water_severity", "color_temperature",
    "color_channel_std", "rms_contrast", "michelson_contrast", "local_contrast",
    "weber_contrast", "lab_contrast", "sharpness_laplacian", "sharpness_gradient",
    "blur_estimate", "edge_density", "multi_scale_edge_density", "corner_density",
    "keypoint_density", "texture_complexity", "visibility_score", "turbidity_score",
    "uciqe_score", "uiqm_score", "entropy_gray", "entropy_color",
    "histogram_uniformity_b", "histogram_uniformity_g", "histogram_uniformity_r",
    "dynamic_range_b", "dynamic_range_g", "dynamic_range_r", "hue_diversity",
    "feature_usefulness_score", "marine_science_value",
)

#: Metrics that are column expressions over other metrics, with what they need.
DERIVED = {
    "blue_dominance": ("blue_channel_mean", "red_channel_mean"),
    "green_dominance": ("green_channel_mean", "red_channel_mean"),
    "blue_green_ratio": ("blue_channel_mean", "green_channel_mean"),
    "blue_water_severity": ("blue_dominance", "green_dominance"),
    "color_temperature": ("blue_channel_mean", "green_channel_mean", "red_channel_mean"),
    "color_channel_std": ("blue_channel_mean", "green_channel_mean", "red_channel_mean"),
    "visibility_score": ("rms_contrast", "sharpness_gradient", "edge_density"),
    "turbidity_score": ("blue_water_severity", "rms_contrast", "blur_estimate", "edge_density"),
    "feature_usefulness_score": ("edge_density", "keypoint_density", "rms_contrast", "sharpness_gradient", "entropy_gray", "turbidity_score"),
    "marine_science_value": ("visibility_score", "turbidity_score", "blue_water_severity", "edge_density", "uciqe_score"),
}

#: Metrics that a kernel has to compute from the pixels, in order.
BASE_NAMES = tuple(n for n in METRIC_NAMES if n not in DERIVED)

METRICS_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in METRIC_NAMES])

#: An image as one row: rows of BGR bytes from the top.
IMAGE_SCHEMA = "path string, height int, width int, channels int, data binary, error string"


def closure(wanted: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """The wanted metrics with all that they are derived from, in fixed order."""
    unknown = [n for n in wanted if n not in METRIC_NAMES]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    todo, found = list(wanted), set()
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += DERIVED.get(name, ())
    return tuple(n for n in METRIC_NAMES if n in found)
