"""Blending image metrics with a model's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from .stats import correlation, spread


def blended(own: DataFrame, model: DataFrame, on: str = "path", weight: float = 0.6, score: str = "overall_score", severity: str = "blue_water_problem_severity") -> DataFrame:
    """Rows of ``own`` with traditional, model and hybrid score and severity.

    model: (on, dl_score, dl_severity), one row per key; where it has none the own values stand.
    """
    joined = own.join(model.select(on, "dl_score", "dl_severity"), on, "left")
    hybrid = joined.withColumns({
        "traditional_score": F.col(score), "traditional_severity": F.col(severity),
        "hybrid_score": scores.blend(score, "dl_score", weight), "hybrid_severity": scores.blend(severity, "dl_severity", weight),
    })
    return hybrid.withColumn("hybrid_category", scores.usability_category("hybrid_score", levels=4))


def hybrid_stats(rows: DataFrame) -> DataFrame:
    """Mean, median and population deviation of the three methods."""
    methods = ("traditional_score", "dl_score", "hybrid_score")
    found = spread(rows, methods)
    return found.select("n", *[f"{c}_{what}" for c in methods for what in ("mean", "median", "std")])


def method_correlation(rows: DataFrame) -> DataFrame:
    pairs = (("traditional_score", "dl_score"), ("traditional_score", "hybrid_score"), ("dl_score", "hybrid_score"))
    return rows.agg(*[correlation(a, b).alias(f"{a.split('_')[0]}_{b.split('_')[0]}") for a, b in pairs])
