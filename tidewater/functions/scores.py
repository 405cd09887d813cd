"""Composite scores, categories and usability: column expressions over metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Lowest scores of the categories (fixed values).
CATEGORIES = ((80.0, "Excellent"), (60.0, "Good"), (40.0, "Fair"), (20.0, "Poor"))


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x between lo and hi; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def half_up(x: str | Column, digits: int) -> Column:
    """Rounded half up by its decimal value: what a product of doubles lacks in its last bits doesn't count."""
    return F.round(F.round(c(x), 9), digits)


def share(name: str, full: float) -> Column:
    """A metric as a part of the value that counts as full, at most one."""
    return clip(c(name) / F.lit(full))


def derived() -> dict[str, Column]:
    """The derived metrics in an order in which each needs earlier ones only."""
    blue, green, red = (c(f"{n}_channel_mean") for n in ("blue", "green", "red"))
    mean = (blue + green + red) / 3
    return {
        "blue_dominance": (blue - red) / 255,
        "green_dominance": (green - red) / 255,
        "blue_green_ratio": blue / (green + EPS),
        "blue_water_severity": clip(c("blue_dominance") + 0.5 * c("green_dominance")),
        "color_temperature": (blue + green) / (red + EPS),
        "color_channel_std": F.sqrt(((blue - mean) * (blue - mean) + (green - mean) * (green - mean) + (red - mean) * (red - mean)) / 3),
        "visibility_score": 0.4 * share("rms_contrast", 0.5) + 0.4 * share("sharpness_gradient", 30) + 0.2 * share("edge_density", 0.2),
        "turbidity_score": 0.3 * c("blue_water_severity") + 0.3 * (1 - share("rms_contrast", 0.5)) + 0.2 * c("blur_estimate") + 0.2 * (1 - share("edge_density", 0.2)),
        "feature_usefulness_score": 25 * share("edge_density", 0.2) + 20 * share("keypoint_density", 2) + 20 * share("rms_contrast", 0.5)
        + 15 * share("sharpness_gradient", 30) + 10 * share("entropy_gray", 7.5) + 10 * (1 - c("turbidity_score")),
        "marine_science_value": 30 * c("visibility_score") + 25 * (1 - c("turbidity_score")) + 20 * (1 - c("blue_water_severity"))
        + 15 * share("edge_density", 0.2) + 10 * share("uciqe_score", 0.6),
    }


def overall_score() -> Column:
    return clip(0.35 * c("feature_usefulness_score") + 0.35 * c("marine_science_value") + 20 * c("visibility_score") - 10 * c("blue_water_severity"), 0.0, 100.0)


def blue_water_problem_severity() -> Column:
    """0 to 10."""
    return 5 * c("blue_water_severity") + 3 * c("turbidity_score") + 2 * (1 - share("rms_contrast", 0.5))


def usability_category(score: str | Column = "overall_score", levels: int = 5) -> Column:
    """Excellent to Unusable; with 4 levels the last is Poor."""
    if levels not in (4, 5):
        raise ValueError("there are 4 or 5 levels")
    x, steps = c(score), CATEGORIES[: levels - 1]
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for least, name in steps:
        out = out.when(x >= least, name)
    return out.otherwise("Unusable" if levels == 5 else "Poor")


def colour_quality(ratio: Column | str = "blue_green_ratio", rms: Column | str = "rms_contrast") -> Column:
    ratio, rms = F.coalesce(c(ratio), F.lit(0.5)), F.coalesce(c(rms), F.lit(0.0))
    return half_up(0.6 * F.greatest(F.lit(0.0), 100 * (1 - 2 * F.abs(ratio - 0.5))) + 0.4 * F.least(F.lit(100.0), 400 * rms), 1)


def severity_label(severity: Column | str = "blue_water_problem_severity") -> Column:
    x = c(severity)
    return F.when(x >= 7, "Severe").when(x >= 5, "Moderate").when(x >= 3, "Mild").otherwise("Minimal")


def score_colour(score: Column | str = "overall_score") -> Column:
    x = c(score)
    return F.when(x >= 80, "green").when(x >= 60, "lightgreen").when(x >= 40, "yellow").when(x >= 20, "orange").otherwise("red")


def severity_colour(severity: Column | str = "blue_water_severity") -> Column:
    x = c(severity)
    return F.when(x >= 0.7, "red").when(x >= 0.5, "orange").when(x >= 0.3, "yellow").otherwise("green")


def _usability(score: str, strong: str, weak: str, reasons: list[tuple[Column, str]]) -> Column:
    why = F.concat_ws(", ", F.array_compact(F.array(*[F.when(p, text) for p, text in reasons])))
    x = c(score)
    text = F.when(x >= 50, strong).when(x >= 30, weak).otherwise(F.concat(F.lit("Insufficient: "), F.when(why == "", "low score").otherwise(why)))
    return F.struct((x >= 30).alias("usable"), text.alias("reason"))


def cv_usability() -> Column:
    """(usable, reason) for computer vision tasks."""
    return _usability("feature_usefulness_score", "Sufficient features", "Marginal features", [
        (c("edge_density") < 0.05, "few edges"), (c("keypoint_density") < 0.5, "few keypoints"),
        (c("visibility_score") < 0.3, "poor visibility"), (c("blur_estimate") > 0.7, "strong blur"),
    ])


def marine_usability() -> Column:
    """(usable, reason) for marine science."""
    return _usability("marine_science_value", "Sufficient quality", "Marginal quality", [
        (c("blue_water_severity") > 0.7, "severe blue water"), (c("turbidity_score") > 0.7, "high turbidity"),
        (c("visibility_score") < 0.3, "poor visibility"), (c("rms_contrast") < 0.2, "low contrast"),
    ])


def blend(own: Column | str, other: Column | str, weight: float = 0.6) -> Column:
    """weight * other + (1 - weight) * own; own alone where there is no other."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight has to lie between 0 and 1")
    return F.when(c(other).isNull(), c(own)).otherwise(weight * c(other) + (1 - weight) * c(own))
