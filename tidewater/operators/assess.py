"""Images to metrics, scores, categories and texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scores
from ..functions.kernels import KERNELS, Image, shrink, three_channels
from ..functions.names import DERIVED, METRIC_NAMES, closure
from ..sources.images import is_folder, read_file

Metric = Callable[[Image], float]
#: Images in one Arrow batch; a megapixel image has some megabytes.
BATCH = 8


class MetricRegistry:
    """Named metrics of the user's own: functions of an image that return a float.

    The functions travel with the query, so that they work on every executor.
    """

    def __init__(self) -> None:
        self._own: dict[str, Metric] = {}

    def register_metric(self, name: str, fn: Metric | None = None):  # noqa: ANN201
        """Add a metric, directly or as a decorator; the name of a built-in one is refused, an own one replaced."""
        if name in METRIC_NAMES:
            raise ValueError(f"{name} is a built-in metric")
        if fn is None:
            return lambda f: self.register_metric(name, f)
        self._own[name] = fn
        return fn

    def unregister_metric(self, name: str) -> bool:
        return self._own.pop(name, None) is not None

    def registered_metrics(self) -> list[str]:
        return sorted(self._own)

    def copy(self) -> dict[str, Metric]:
        """Name and function of each metric, in the order of registration."""
        return dict(self._own)


#: The registry that the functions below use unless given another.
registry = MetricRegistry()


def scaled(bgr: np.ndarray, scale: float, max_side: int | None) -> np.ndarray:
    """The image at the scale, and no side longer than max_side."""
    if max_side and max(bgr.shape[:2]) * scale > max_side:
        scale = max_side / max(bgr.shape[:2])
    if scale == 1.0:
        return bgr
    height, width = int(bgr.shape[0] * scale), int(bgr.shape[1] * scale)
    if not height or not width:
        raise ValueError("nothing is left of the image at this scale")
    return shrink(bgr, height, width)


def base_metrics(
    images: DataFrame, metrics: Sequence[str] = METRIC_NAMES, scale: float = 1.0, max_side: int | None = None, own: MetricRegistry | None = None,
) -> DataFrame:
    """The rows of ``images`` without their pixels, with the base metrics that ``metrics`` need.

    images: (path, height, width, channels, data, error, ...).  Only the pixels travel to
    the kernels with the other columns; a failing image gets nulls and its ``error``.
    Filters and limits belong before this step: Spark can't move them past it.
    """
    if scale <= 0:
        raise ValueError("the scale has to be positive")
    names = [n for n in closure(list(metrics)) if n not in DERIVED]
    custom = (own or registry).copy()
    kept = [c for c in images.columns if c not in ("data", "error", "channels")]
    types = {f.name: f.dataType.simpleString() for f in images.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{n} double" for n in names] + ["custom map<string,double>", "error string"])
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    def measure(data: bytes | None, height: int | None, width: int | None, channels: int | None) -> tuple[list[float | None], list, str | None]:
        try:
            if data is None:
                raise ValueError("the file can't be decoded")
            image = Image(scaled(three_channels(data, height or 0, width or 0, channels or 0), scale, max_side))
            return [KERNELS[n](image) for n in names], [(n, float(f(image))) for n, f in custom.items()], None
        except Exception as e:  # noqa: BLE001  a bad image is a row, not the end of the job
            return [None] * len(names), [], f"{type(e).__name__}: {e}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("data", "height", "width", "channels", "error")]
            made = [([None] * len(names), [], e) if e is not None else measure(d, h, w, k) for d, h, w, k, e in zip(*columns, strict=True)]
            values = [pa.array([m[0][i] for m in made], pa.float64()) for i in range(len(names))]
            extra = pa.array([m[1] for m in made], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *values, extra, pa.array([m[2] for m in made], pa.string())], names=[*kept, *names, "custom", "error"])

    return images.mapInArrow(each, schema)


def with_derived(metrics: DataFrame, wanted: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Add the derived metrics among ``wanted`` (and what they need) as column expressions."""
    need = set(closure(list(wanted)))
    for name, expr in scores.derived().items():
        if name in need and name not in metrics.columns:
            metrics = metrics.withColumn(name, expr)
    return metrics


def measure(images: DataFrame, metrics: Sequence[str] = METRIC_NAMES, **options) -> DataFrame:  # noqa: ANN003
    """Images to metric columns: kernels for the base metrics, expressions for the rest."""
    found = with_derived(base_metrics(images, metrics, **options), metrics)
    rest = [c for c in found.columns if c not in METRIC_NAMES and c not in ("custom", "error")]
    return found.select(*rest, *[n for n in closure(list(metrics))], "custom", "error")


def fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once for each row, whatever filters or sorts by them later.

    A filter moves below plain columns and brings their whole expressions with it, each as often as
    another needs it; it stays above columns that are generated.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.withColumns(columns).select(*kept, F.inline(F.array(F.struct(*columns))))
    return made.select(*df.columns, *[c for c in columns if c not in df.columns])


def with_scores(metrics: DataFrame) -> DataFrame:
    """Add the composite scores, the category and the texts to metric columns; the scores and derived metrics are fixed."""
    found = metrics.withColumns({"overall_score": scores.overall_score(), "blue_water_problem_severity": scores.blue_water_problem_severity()})
    found = fixed(found, {c: F.col(c) for c in (*DERIVED, "overall_score", "blue_water_problem_severity") if c in found.columns})
    whole = F.col("overall_score").isNotNull()
    return found.withColumns({
        "usability_category": scores.usability_category(),
        "colour_quality": F.when(whole, scores.colour_quality()),
        "feature_quality": F.col("feature_usefulness_score"),
        "blue_water_score": F.col("blue_water_problem_severity"),
        "recommendations": F.when(whole, rules.recommendations()),
        "warnings": F.when(whole, rules.warnings()),
    })


def assess(images: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Images to complete assessments: all metrics, scores, category and texts; failures keep their error."""
    return with_scores(measure(images, **options))


def assess_image(spark: SparkSession, image: str | np.ndarray, scale: float = 1.0, max_side: int | None = None) -> Row:
    """One image file, or one array of rows of blue, green and red (or grey), as an assessment: scores, category, texts and ``detailed_metrics``.

    FileNotFoundError where there is no file or it can't be decoded.  For many images ``assess`` a table of them.
    """
    if isinstance(image, str):
        if is_folder(spark, image) is not False:
            raise FileNotFoundError(image)
        rows = read_file(spark, image)
    else:
        pixels = image[..., None] if image.ndim == 2 else image
        kind = "path string, height int, width int, channels int, data binary, error string"
        rows = spark.createDataFrame([("array", *pixels.shape, np.ascontiguousarray(pixels, np.uint8).tobytes(), None)], kind)
    found = nested(assess(rows, scale=scale, max_side=max_side)).first()
    if found is None or found.error is not None:
        raise FileNotFoundError(f"{image if isinstance(image, str) else 'array'}: {found.error if found else 'no image'}")
    return found.assessment


def nested(assessed: DataFrame) -> DataFrame:
    """Assessments as (filename, filepath, error, assessment struct), null for failures."""
    whole = F.struct(
        "overall_score", F.col("feature_usefulness_score").alias("feature_usefulness"), "marine_science_value", "blue_water_problem_severity", "usability_category",
        F.struct(*METRIC_NAMES).alias("detailed_metrics"), "custom", "recommendations", "warnings", "feature_quality", "colour_quality", "blue_water_score",
    )
    return assessed.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("filepath"), "error", F.when(F.col("error").isNull(), whole).alias("assessment"))
