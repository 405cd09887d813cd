"""A regressor on metric vectors in place of neural networks, and batch prediction with any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import shrink, three_channels
from ..functions.names import METRIC_NAMES


def train_regressor(rows: DataFrame, label: str = "quality_score", features: Sequence[str] = METRIC_NAMES, kind: str = "linear", seed: int = 42) -> PipelineModel:
    """Fit scores to metric columns with Spark ML (``linear`` or ``trees``); nulls become means."""
    if kind not in ("linear", "trees"):
        raise ValueError("kinds are linear and trees")
    used = list(features)
    filled = [f"{c}_filled" for c in used]
    last = LinearRegression(featuresCol="features", labelCol=label, regParam=0.1) if kind == "linear" else GBTRegressor(featuresCol="features", labelCol=label, seed=seed)
    return Pipeline(stages=[Imputer(inputCols=used, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), last]).fit(rows.where(F.col(label).isNotNull()))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``dl_score``, clipped to 0 and 100."""
    found = model.transform(rows)
    return found.select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(100.0), "prediction")).alias("dl_score"))


def evaluate(predicted: DataFrame, label: str = "quality_score") -> DataFrame:
    """(n, mae, mse, correlation) of predictions."""
    gap = F.col("dl_score") - F.col(label)
    both = F.try_divide(F.covar_pop("dl_score", label), F.stddev_pop("dl_score") * F.stddev_pop(label))
    return predicted.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), both.alias("correlation"))


def predict_images(images: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], outputs: Sequence[str] = ("dl_score", "dl_severity"), side: int = 384, batch: int = 8) -> DataFrame:
    """(path, outputs..., error): images through a model that ``load`` makes once in each task.

    The model gets (n, side, side, 3) RGB values from 0 to 1 and returns (n, outputs); a failing image
    becomes an error row and keeps the others of its batch.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            good, planes, errors = [], [], [None] * rows.num_rows
            for i, (data, h, w, k) in enumerate(zip(*(rows.column(n).to_pylist() for n in ("data", "height", "width", "channels")), strict=True)):
                try:
                    planes.append(shrink(three_channels(data or b"", h or 0, w or 0, k or 0), side, side)[..., ::-1] / np.float32(255))
                    good.append(i)
                except ValueError as e:
                    errors[i] = str(e)
            values = np.full((rows.num_rows, len(outputs)), np.nan)
            if good:
                values[good] = model(np.stack(planes))
            cols = [pa.array([None if np.isnan(v) else float(v) for v in values[:, j]], pa.float64()) for j in range(len(outputs))]
            yield pa.RecordBatch.from_arrays([rows.column("path"), *cols, pa.array(errors, pa.string())], names=["path", *outputs, "error"])

    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    return images.select("path", "height", "width", "channels", "data").mapInArrow(each, "path string, " + "".join(f"{o} double, " for o in outputs) + "error string")
