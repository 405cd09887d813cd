"""Synthetic training images: noise with a blue tint, less contrast and known labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, height int, width int, channels int, data binary, error string, quality_score double, blue_water_severity double"


def synthetic_images(spark: SparkSession, n: int = 1000, side: int = 384, seed: int = 42) -> DataFrame:
    """n image rows with their labels; each row has its own seed, so that partitions don't matter."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                severity = float(rng.uniform(0, 10))
                x = rng.integers(0, 256, (side, side, 3)).astype(float)
                x[..., 0] += severity * 8
                x[..., 2] *= 1 - severity / 15
                x = (x - x.mean()) * (1 - severity / 20) + x.mean() + rng.normal(0, severity, x.shape)
                rows.append({
                    "path": f"synthetic_{i:06d}.png", "height": side, "width": side, "channels": 3, "data": np.clip(x, 0, 255).astype(np.uint8).tobytes(), "error": None,
                    "quality_score": 100 * (1 - severity / 10), "blue_water_severity": severity,
                })
            kinds = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("error", pa.string()), ("quality_score", pa.float64()), ("blue_water_severity", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return spark.range(n).mapInArrow(each, SCHEMA)
