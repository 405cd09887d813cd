"""Results as CSV, JSON, label and text files; Spark's writers do the work, one file per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import half_up

#: Metrics of the CSV file (fixed values).
CSV_METRICS = ("blue_water_severity", "turbidity_score", "visibility_score", "rms_contrast", "sharpness_gradient", "edge_density", "uciqe_score", "uiqm_score")


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def csv_rows(assessed: DataFrame) -> DataFrame:
    """The columns of the batch file; a failed image has its name, ERROR and nothing else."""
    ok = F.col("error").isNull()
    value = lambda c: F.when(ok, F.col(c))
    return assessed.select(
        _name().alias("filename"), F.when(ok, F.col("overall_score").cast("string")).otherwise("ERROR").alias("overall_score"), value("usability_category").alias("usability_category"),
        value("feature_usefulness_score").alias("feature_usefulness"), value("marine_science_value").alias("marine_science_value"), value("blue_water_problem_severity").alias("blue_water_problem_severity"),
        *[value(n).alias(n) for n in CSV_METRICS],
    )


def model_csv_rows(results: DataFrame) -> DataFrame:
    """filename, filepath, score and those of the optional columns that the table has."""
    optional = [c for c in ("dl_severity", "usability_category", "confidence") if c in results.columns]
    return results.where("error is null").select(_name().alias("filename"), F.col("path").alias("filepath"), F.col("dl_score").alias("overall_score"), *optional)


def hybrid_csv_rows(rows: DataFrame, detailed: bool = False) -> DataFrame:
    """Name, score, category and the scores of the three methods; detailed: the own feature usefulness and severity as well.

    A failed image has its name, ERROR and nothing else.
    """
    ok = F.col("error").isNull()
    value = lambda c, name: F.when(ok, F.col(c)).alias(name)
    more = [value("feature_usefulness_score", "traditional_feature_usefulness"), value("traditional_severity", "traditional_blue_water_severity")] if detailed else []
    return rows.select(
        _name().alias("filename"), F.when(ok, F.col("hybrid_score").cast("string")).otherwise("ERROR").alias("overall_score"), value("hybrid_category", "usability_category"),
        value("traditional_score", "traditional_score"), value("dl_score", "deep_learning_score"), value("hybrid_score", "hybrid_score"), *more,
    )


def web_csv_rows(assessed: DataFrame) -> DataFrame:
    """Seven columns as text with fixed decimals, without failures."""
    two = lambda c: F.format_string("%.2f", half_up(c, 2))
    return assessed.where("error is null").select(
        _name().alias("filename"), two("overall_score").alias("overall_score"), "usability_category", two("feature_usefulness_score").alias("feature_usefulness"), two("marine_science_value").alias("marine_science_value"),
        two("blue_water_problem_severity").alias("blue_water_severity"), F.format_string("%.3f", half_up("visibility_score", 3)).alias("visibility_score"),
    )


def example_csv_rows(assessed: DataFrame) -> DataFrame:
    return assessed.where("error is null").select(_name().alias("filename"), half_up("overall_score", 2).alias("overall_score"), "usability_category", half_up("feature_usefulness_score", 2).alias("feature_usefulness"), half_up("marine_science_value", 2).alias("marine_science_value"), half_up("blue_water_problem_severity", 2).alias("blue_water_severity"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines; ``by`` makes folders that later reads can skip."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).json(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """(key, json): each row as one JSON object."""
    return rows.select(rows.columns[0], F.to_json(F.struct(*rows.columns)).alias("json"))


def report_lines(assessed: DataFrame) -> DataFrame:
    """(path, report): the detailed text of each assessment."""
    number = lambda label, c, f: F.format_string(f"{label:<24}{f}", half_up(c, int(f[2])))
    listed = lambda title, c: F.concat_ws("\n", F.lit(title), F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))
    return assessed.where("error is null").select("path", F.concat_ws(
        "\n", F.lit("IMAGE QUALITY REPORT"), F.format_string("%-24s%s", F.lit("Category"), F.col("usability_category")), number("Overall score", "overall_score", "%.1f"),
        number("Feature usefulness", "feature_usefulness_score", "%.1f"), number("Marine science value", "marine_science_value", "%.1f"), number("Blue water (0-10)", "blue_water_problem_severity", "%.1f"),
        number("Visibility", "visibility_score", "%.3f"), number("Turbidity", "turbidity_score", "%.3f"), listed("Recommendations", "recommendations"), listed("Warnings", "warnings"),
    ).alias("report"))


def summary_line(assessed: DataFrame) -> DataFrame:
    """(path, summary): score and category in one line."""
    return assessed.where("error is null").select("path", F.format_string("%s (%.1f/100): features %.1f, science %.1f, blue water %.1f/10", "usability_category", *[half_up(c, 1) for c in ("overall_score", "feature_usefulness_score", "marine_science_value", "blue_water_problem_severity")]).alias("summary"))


def video_report(summary: DataFrame) -> DataFrame:
    """(video_id, report): the text of each video summary."""
    return summary.select("video_id", F.concat_ws(
        "\n", F.format_string("Video %s: %.1f/100 over %d frames", F.col("video_id").cast("string"), "overall_video_score", "analyzed_frames"),
        F.format_string("Scores %.1f to %.1f, mean %.1f, std %.1f", "min_frame_score", "max_frame_score", "average_frame_score", "quality_std"),
        F.format_string("Stability %.2f, blue water %.1f/10", "temporal_stability", "blue_water_severity_avg"), F.concat_ws("\n", "recommendations"), F.concat_ws("\n", "warnings"),
    ).alias("report"))


def filter_report(summary: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(video_id, json): the filter's summary and, where the judged frames are given, a record of each in order.

    A video's report is one document, so its frames' records meet in one row.
    """
    if frames is None:
        return summary.select("video_id", F.to_json(F.struct(*summary.columns)).alias("json"))
    own = [c for c in frames.columns if c != "video_id"]
    records = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("frames"))
    return summary.join(records, "video_id", "left").select("video_id", F.to_json(F.struct(*summary.columns, "frames")).alias("json"))


def pending(images: DataFrame, done: DataFrame, on: str = "path") -> DataFrame:
    """Images that an earlier run has no result of: what a resumed run still has to do."""
    return images.join(done.select(on), on, "left_anti")
