"""One query per operator, over the star-schema tables as tiles, frame series and metric rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour, scores
from ..functions.names import METRIC_NAMES
from ..operators import assess, hybrid, labels, learn, panels, pictures, pixels, select, stats, temporal, tiled, train
from ..sources import images, sinks, tables, video
from ..sources.files import shared_path
from ..sources.pictures import write_pictures
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def tile_images(spark: SparkSession, sf_dir: str, side: int = 27, suppliers: int = 1) -> DataFrame:
    return images.from_pixels(tables.tiles(spark, sf_dir, side, suppliers))


def grey_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 grey tiles from the embeddings, as image rows."""
    v = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.6) / 1.2 * 256).cast("int"))))
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), v.alias("v"))
    return images.from_arrays(rows, "vec_id", "v", "v", "v")


def kernel(*names: str, side: int = 27, suppliers: int = 1) -> Query:
    """Metrics by kernels over tiles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = assess.measure(tile_images(spark, sf_dir, side, suppliers), names)
        return found.select(F.col("path").cast("long").alias("image_id"), *r6(*names))

    return run


def on_pixels(fn: Callable[[DataFrame], DataFrame], *keys: str, side: int = 27, suppliers: int = 1) -> Query:
    """An aggregate over pixel rows, its numbers rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fn(tables.tiles(spark, sf_dir, side, suppliers))
        return found.select(*[c if c in ("image_id", "channel", *keys) else F.round(c, 6).alias(c) for c in found.columns])

    return run


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.with_scores(assess.with_derived(tables.metric_rows(spark, sf_dir)))


def blur_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess.measure(grey_tiles(spark, sf_dir), ["blur_estimate", "sharpness_laplacian"])
    return found.select(F.col("path").cast("long").alias("image_id"), *r6("blur_estimate", "sharpness_laplacian"))


def gray_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.entropies(tables.tiles(spark, sf_dir), {"gray": pixels.grey()}).select("image_id", F.round("entropy", 6).alias("entropy_gray"))


def channel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = pixels.entropies(tables.tiles(spark, sf_dir), {n: F.col(n) for n in "bgr"})
    return per.groupBy("image_id").agg(F.round(F.sum("entropy") / 3, 6).alias("entropy_color"))


def hue_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hue = colour.hue(F.col("b"), F.col("g"), F.col("r"))
    return pixels.entropies(tables.tiles(spark, sf_dir), {"hue": hue}).select("image_id", F.round("entropy", 6).alias("hue_diversity"))


def uiqm_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UIConM and UISM as custom metrics: the registry's functions travel with the query."""
    from ..functions.kernels import eme

    own = assess.MetricRegistry()
    own.register_metric("uism", lambda m: eme(m.gradient))
    own.register_metric("uiconm", lambda m: m.uiconm())
    found = assess.base_metrics(tile_images(spark, sf_dir), ["red_channel_mean"], own=own)
    return found.select(F.col("path").cast("long").alias("image_id"), *[F.round(F.col("custom")[n], 6).alias(n) for n in ("uism", "uiconm")])


def custom_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assess.MetricRegistry()
    own.register_metric("red_share", lambda m: float(m.bgr[..., 2].sum()) / max(1.0, float(m.bgr.sum())))
    found = assess.base_metrics(tile_images(spark, sf_dir), ["red_channel_mean"], own=own)
    return found.select(F.col("path").cast("long").alias("image_id"), F.round(F.col("custom")["red_share"], 6).alias("red_share"))


def tiled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood metrics of pixel rows, cut into tiles of 32 pixels with halos."""
    names = ("local_contrast", "texture_complexity", "sharpness_laplacian", "sharpness_gradient", "edge_density")
    return tiled.measure(tables.tiles(spark, sf_dir, 54, 4), names, size=32).select("image_id", *r6(*names))


def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of a run that learns the scores of images from their metrics, a fifth of the images held out."""
    rows = scored(spark, sf_dir).where("error is null").withColumn("held", F.crc32("path") % 5 == 0)
    names = [n for n, *_ in tables.METRIC_COLUMNS]
    state = train.train(rows, 6, shared_path(spark, "run"), "overall_score", "blue_water_problem_severity", "held", names)
    return train.history(spark, state)


def tile_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about every tile: 37 metrics, scores, category, texts."""
    found = assess.assess(tile_images(spark, sf_dir))
    return found.select(F.col("path").cast("long").alias("image_id"), *r6(*METRIC_NAMES, "overall_score", "blue_water_problem_severity", "colour_quality"), "usability_category", F.array_join("recommendations", "; ").alias("recommendations"), F.array_join("warnings", "; ").alias("warnings"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to assessments to a summary of each category."""
    found = assess.assess(tile_images(spark, sf_dir)).where("error is null")
    return found.groupBy("usability_category").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("overall_score", "blue_water_problem_severity", "visibility_score", "uiqm_score")]).orderBy("usability_category")


def cols(*names: str) -> Query:
    """Score columns of the valid metric rows, rounded where they are numbers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scored(spark, sf_dir).where("error is null")
        kinds = dict(found.dtypes)
        return found.select("path", *[F.round(n, 6).alias(n) if kinds[n] == "double" else F.array_join(n, "; ").alias(n) if kinds[n].startswith("array") else n for n in names])

    return run


def labels_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir).where("error is null")
    return found.select("path", scores.severity_label().alias("severity_label"), scores.score_colour().alias("score_colour"), scores.severity_colour().alias("severity_colour"))


def usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir).where("error is null").select("path", scores.cv_usability().alias("v"), scores.marine_usability().alias("m"))
    return found.select("path", F.col("v.usable").alias("cv_usable"), F.col("v.reason").alias("cv_reason"), F.col("m.usable").alias("marine_usable"), F.col("m.reason").alias("marine_reason"))


def by_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch summary of every survey folder in one job."""
    found = stats.summary(scored(spark, sf_dir).withColumn("survey", F.element_at(F.split("path", "/"), 1)), ["survey"])
    means = [c for c in found.columns if c.startswith("average_")]
    parts = F.array_sort(F.transform(F.map_entries("category_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return found.select("survey", "total_images", "successful_assessments", "failed_assessments", *r6(*means), F.array_join(parts, ",").alias("categories"))


def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(scored(spark, sf_dir)).withColumn("percentage", F.round("percentage", 6))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.frames(spark, sf_dir).withColumn("usability_category", scores.usability_category())


def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.spread(frames(spark, sf_dir), ["overall_score"])
    return found.select("n", *r6(*[c for c in found.columns if c != "n"]))


def ranked(which: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return which(scored(spark, sf_dir).where("error is null")).select("path", *r6("overall_score", "blue_water_problem_severity"))

    return run


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranking(scored(spark, sf_dir).select("path", "overall_score")).select("path", F.round("overall_score", 6).alias("overall_score"), "rank")


def web_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.web_summary(scored(spark, sf_dir))
    return found.select("total", "successful", *r6("mean", "median", "least", "largest", "std"))


def batch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 32))
    found = stats.batch_means(rows, "batch", ["value"])
    return found.select("batches", F.round("value", 6).alias("value"))


def video_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of tiles, one of each supplier, written as files and read again: every second frame, four of each."""
    whole = tile_images(spark, sf_dir, side=8)
    key = F.col("path").cast("long")
    path = shared_path(spark, "videos")
    video.write_clips(whole.select(F.floor(key / tables.MOST_TILES).alias("video_id"), (key % tables.MOST_TILES).alias("frame_idx"), "height", "width", "data"), path, fps=25.0)
    seen = video.read_clips(spark, path, every=2, max_frames=4)
    found = assess.measure(seen, ["blue_channel_mean", "green_channel_mean", "red_channel_mean"])
    return found.select(F.col("video_id").cast("long").alias("video_id"), "frame_idx", "total_frames", *r6("t", "blue_channel_mean", "green_channel_mean", "red_channel_mean"))


def edge_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pictures with yellow edges show: their mean colours, and the pixels of the edge maps."""
    whole = tile_images(spark, sf_dir)
    shown = images.to_pixels(pictures.overlays(whole)).groupBy("image_id").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in "bgr"])
    edges = pictures.edge_maps(whole).select(F.col("path").alias("image_id"), F.length(F.replace(F.hex("data"), F.lit("00"), F.lit(""))).alias("n"))
    return shown.join(edges, "image_id").select(F.col("image_id").cast("long").alias("image_id"), (F.col("n") / 2).cast("long").alias("edge_pixels"), "mean_b", "mean_g", "mean_r")


def temporal_query(fn: Callable[[DataFrame], DataFrame], *names: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fn(frames(spark, sf_dir))
        kinds = dict(found.dtypes)
        used = names or tuple(c for c in found.columns if c != "video_id")
        return found.select("video_id", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else c for c in used])

    return run


def model_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as images: their lengths give one method's score, their labels, which some have, the model's."""
    docs, marks = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    own = docs.select(F.col("doc_id").alias("path"), F.least(F.lit(100.0), F.col("n_chars") / 50.0).alias("overall_score"), (F.col("n_chars") % 11).cast("double").alias("blue_water_problem_severity"))
    model = marks.select(F.col("doc_id").alias("path"), (F.col("quality") * 60.0 + F.col("doc_id") % 41).alias("dl_score"), (F.col("toxic") * 5.0 + F.col("doc_id") % 5).alias("dl_severity"))
    return own, model


def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hybrid.blended(*model_scores(spark, sf_dir))
    return found.select("path", *r6("traditional_score", "dl_score", "hybrid_score", "hybrid_severity"), "hybrid_category")


def hybrid_of(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fn(hybrid.blended(*model_scores(spark, sf_dir)))
        return found.select(*[c if c == "n" else F.round(c, 6).alias(c) for c in found.columns])

    return run


def chosen(**how) -> Query:  # noqa: ANN003
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select.select(tables.table(spark, sf_dir, "documents").select("doc_id", "source"), by="doc_id", **how)

    return run


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.every_nth(frames(spark, sf_dir), 5, 6).select("video_id", "frame_idx", F.round("overall_score", 6).alias("overall_score"))


def label_join(which: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = tables.table(spark, sf_dir, "labels").select("doc_id")
        return which(tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), files, "doc_id")

    return run


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.training_labels(scored(spark, sf_dir))
    return found.select("filename", *r6("quality_score", "blue_water_severity", "feature_usefulness"))


def hybrid_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detailed hybrid file: half of an image's own score stands for its feature usefulness."""
    rows = hybrid.blended(*model_scores(spark, sf_dir)).withColumns({"feature_usefulness_score": F.col("traditional_score") / 2, "error": F.lit(None).cast("string")})
    found = sinks.hybrid_csv_rows(rows.withColumn("path", F.col("path").cast("string")), detailed=True)
    numbers = [c for c in found.columns if c not in ("filename", "overall_score", "usability_category")]
    return found.select(F.col("filename").cast("long").alias("filename"), (F.col("overall_score") != "ERROR").alias("scored"), "usability_category", *r6(*numbers))


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.csv_rows(scored(spark, sf_dir))
    score = F.when(F.col("overall_score") == "ERROR", "ERROR").otherwise(F.format_string("%.4f", scores.half_up(F.expr("try_cast(overall_score as double)"), 4)))
    return rows.select("filename", score.alias("overall_score"), "usability_category", *r6("feature_usefulness", "marine_science_value", "blue_water_problem_severity", *sinks.CSV_METRICS))


def web_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.web_csv_rows(scored(spark, sf_dir))


def panel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.channel_histogram(tables.tiles(spark, sf_dir)).withColumn("height", F.round("height", 6))


def panel(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return panels.bars(scored(spark, sf_dir).where("error is null"), name).withColumn("height", F.round("height", 6))

    return run


def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess.measure(tile_images(spark, sf_dir), ["edge_density", "corner_density", "keypoint_density", "texture_complexity"])
    return panels.bars(found, "features").select(F.col("path").cast("long").alias("image_id"), "bar", F.round("height", 6).alias("height"))


def panel_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.overlay(scored(spark, sf_dir).where("error is null")).withColumn("overall_score", F.round("overall_score", 6))


def lab_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles have fewer pixels than the plot takes, so all of them are shown."""
    return panels.lab_scatter(tables.tiles(spark, sf_dir))


def survey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as PNG files in the folders of three surveys, found and decoded again."""
    root = shared_path(spark, "surveys")
    write_pictures(tile_images(spark, sf_dir), root, folder=F.concat(F.lit("survey"), F.col("path").cast("long") % 3))
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id")
    sizes = images.find_images(spark, root, recursive=True).select(number, "length")
    found = assess.measure(images.surveys(spark, root), ["blue_channel_mean", "green_channel_mean", "red_channel_mean"])
    return found.select("*", number).join(sizes, "image_id").select("image_id", "survey", "height", "width", (F.col("length") > 0).alias("listed"), *r6("blue_channel_mean", "green_channel_mean", "red_channel_mean"))


def scaled_read(**how) -> Query:  # noqa: ANN003
    """Means of images that are made smaller before they are measured."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = assess.measure(tile_images(spark, sf_dir, side=26), ["blue_channel_mean", "green_channel_mean", "red_channel_mean"], **how)
        return found.select(F.col("path").cast("long").alias("image_id"), *r6("blue_channel_mean", "green_channel_mean", "red_channel_mean"))

    return run


def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over batches of images: the mean of all values, and the share of red."""

    def load():  # noqa: ANN202
        def model(x):  # noqa: ANN001, ANN202
            import numpy as np

            whole = np.rint(x.astype(np.float64) * 255)
            return np.stack([whole.mean(axis=(1, 2, 3)), whole[..., 0].sum(axis=(1, 2)) / np.maximum(whole.sum(axis=(1, 2, 3)), 1)], axis=1)

        return model

    found = learn.predict_images(tile_images(spark, sf_dir), load, side=27)
    return found.select(F.col("path").cast("long").alias("image_id"), *r6("dl_score", "dl_severity"))


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as JSON lines in a folder for each survey, and read again."""
    path = shared_path(spark, "json")
    rows = scored(spark, sf_dir).select("path", F.element_at(F.split("path", "/"), 1).alias("survey"), "error", "overall_score", "usability_category")
    sinks.write_json(rows, path, ["survey"])
    back = spark.read.schema("path string, error string, overall_score double, usability_category string, survey string").json(path)
    return back.select("path", "survey", "error", F.round("overall_score", 6).alias("overall_score"), "usability_category")


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv(sinks.csv_rows(scored(spark, sf_dir)), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("filename", F.when(F.col("overall_score") == "ERROR", "ERROR").alias("failed"), F.round(F.expr("try_cast(overall_score as double)"), 6).alias("overall_score"), "usability_category", F.round(F.col("visibility_score").cast("double"), 6).alias("visibility_score"))


def model_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = model_scores(spark, sf_dir)
    rows = model.select(F.concat(F.lit("a/b"), "path").alias("path"), "dl_score", "dl_severity", F.when(F.col("path") % 7 == 0, "failed").alias("error"))
    return sinks.model_csv_rows(rows)


def example_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.example_csv_rows(scored(spark, sf_dir))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detailed report and the one-line summary of every image."""
    rows = scored(spark, sf_dir)
    return sinks.report_lines(rows).join(sinks.summary_line(rows), "path")


def filter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter's report of each video says, with its frames."""
    rows = frames(spark, sf_dir)
    told = sinks.filter_report(temporal.filter_summary(rows), temporal.filter_frames(rows))
    kind = "struct<total_frames:long,frames_kept:long,mean_score:double,frames:array<struct<frame:long,overall_score:double,usability:string,kept:boolean>>>"
    found = told.select("video_id", F.from_json("json", kind).alias("j"))
    last = F.element_at("j.frames", -1)
    return found.select("video_id", "j.total_frames", "j.frames_kept", F.round("j.mean_score", 6).alias("mean_score"), F.size("j.frames").alias("records"), last["frame"].alias("last_frame"), last["overall_score"].alias("last_score"), last["kept"].alias("last_kept"))


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("overall_score", F.when(F.col("customer") % 5 != 0, F.col("overall_score")))
    return select.valid(rows, scored=True).select("path", F.round("overall_score", 6).alias("overall_score"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame properties from JSON text: the keys and the number of events that have them."""
    keys = tables.table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of scores by time."""
    rows = tables.table(spark, sf_dir, "events").select(F.least(F.lit(100.0), "value").alias("score"), F.date_trunc("hour", "ts").alias("hour"))
    return rows.groupBy("hour").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("min_score"))


def best_by_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("error is null").withColumn("survey", F.element_at(F.split("path", "/"), 1))
    place = F.row_number().over(Window.partitionBy("survey").orderBy(F.desc("overall_score"), "path"))
    return rows.withColumn("rank", place).where("rank <= 5").select("survey", "rank", "path", F.round("overall_score", 6).alias("overall_score"))


QUERIES: dict[str, Query] = {
    "colour_cast": on_pixels(pixels.colour_cast),
    "global_contrast": on_pixels(pixels.global_contrast),
    "lab_uciqe": on_pixels(pixels.lab_metrics),
    "uicm": on_pixels(pixels.uicm),
    "weber_contrast": on_pixels(pixels.weber, side=54, suppliers=4),
    "weber_kernel": kernel("weber_contrast", side=54, suppliers=4),
    "fast_metrics": on_pixels(pixels.fast_metrics),
    "histogram_distribution": on_pixels(pixels.distribution),
    "gray_entropy": gray_entropy,
    "channel_entropy": channel_entropy,
    "hue_diversity": hue_diversity,
    "local_contrast": kernel("local_contrast", "texture_complexity", side=54, suppliers=4),
    "sharpness": kernel("sharpness_laplacian", "sharpness_gradient"),
    "harris_corner_density": kernel("corner_density"),
    "canny_edge_density": kernel("edge_density"),
    "multi_scale_edge_density": kernel("multi_scale_edge_density"),
    "fast_keypoints": kernel("keypoint_density"),
    "relational_kernels": kernel("rms_contrast", "michelson_contrast", "lab_contrast", "uciqe_score", "entropy_gray", "entropy_color", "hue_diversity"),
    "blur_dft": blur_dft,
    "uiqm_parts": uiqm_parts,
    "custom_metric_udf": custom_metric,
    "tiled_metrics": tiled_metrics,
    "training_history": training_history,
    "tile_assessment": tile_assessment,
    "flagship": flagship,
    "visibility_turbidity": cols("visibility_score", "turbidity_score"),
    "usefulness": cols("feature_usefulness_score", "marine_science_value"),
    "overall_score": cols("overall_score", "blue_water_problem_severity", "usability_category"),
    "colour_quality": cols("colour_quality"),
    "recommendations": cols("recommendations"),
    "warnings": cols("warnings"),
    "labels_and_colours": labels_text,
    "usability": usability,
    "batch_summary": by_survey,
    "category_distribution": category_distribution,
    "score_spread": score_spread,
    "top_10": ranked(lambda d: stats.top(d)),
    "bottom_10": ranked(lambda d: stats.bottom(d)),
    "high_quality": ranked(lambda d: stats.high_quality(d, above=40.0)),
    "low_quality": ranked(lambda d: stats.low_quality(d)),
    "severe_blue_water": ranked(lambda d: stats.severe_blue_water(d)),
    "ranking": ranking,
    "best_by_survey": best_by_survey,
    "web_summary": web_summary,
    "batch_means": batch_means,
    "temporal_metrics": temporal_query(temporal.temporal_metrics),
    "temporal_diffs": temporal_query(temporal.with_diffs, "frame_idx", "quality_diff", "blue_water_diff", "visibility_diff"),
    "video_summary": temporal_query(temporal.video_summary),
    "video_scan": video_scan,
    "edge_overlay": edge_overlay,
    "best_frames": temporal_query(lambda f: temporal.best_frames(f, 10).withColumn("name", temporal.frame_name()), "frame_idx", "rank", "overall_score", "name"),
    "timeline": temporal_query(temporal.timeline),
    "frame_sampling": frame_sampling,
    "frame_filter": temporal_query(temporal.filter_frames),
    "frame_filter_report": temporal_query(temporal.filter_summary),
    "hybrid_blend": hybrid_blend,
    "hybrid_stats": hybrid_of(hybrid.hybrid_stats),
    "method_correlation": hybrid_of(hybrid.method_correlation),
    "select_first": chosen(first_n=20),
    "select_last": chosen(last_n=20),
    "select_random": chosen(random_n=20),
    "label_join": label_join(labels.labelled),
    "label_missing": label_join(labels.missing),
    "training_labels": training_labels,
    "hybrid_csv": hybrid_csv,
    "csv_projection": csv_projection,
    "web_csv": web_csv,
    "panel_histogram": panel_histogram,
    "panel_indicators": panel("blue_water"),
    "panel_contrast": panel("contrast"),
    "panel_scores": panel("scores"),
    "panel_channels": panel("channels"),
    "panel_underwater": panel("underwater"),
    "panel_gauges": panel("gauges"),
    "panel_features": panel_features,
    "panel_overlay": panel_overlay,
    "lab_scatter": lab_scatter,
    "survey_files": survey_files,
    "scaled_read": scaled_read(scale=0.5),
    "bounded_read": scaled_read(max_side=13),
    "model_batches": model_batches,
    "json_sink": json_sink,
    "csv_sink": csv_sink,
    "model_csv": model_csv,
    "example_csv": example_csv,
    "report_text": report_text,
    "filter_json": filter_json,
    "valid_rows": valid_rows,
    "select_limit": chosen(limit=20),
    "select_all": chosen(),
    "json_fields": json_fields,
    "event_windows": event_windows,
}

ORACLE_SQL = oracle.SQL
