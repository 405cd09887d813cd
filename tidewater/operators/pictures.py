"""Pictures made of images: edge maps, edges drawn over the image, comparisons side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import canny, three_channels
from ..functions.colour import np_grey

#: Edges are drawn in yellow (a fixed value), here in the order blue, green, red.
EDGE = (0, 255, 255)


def edge_map(bgr: np.ndarray) -> np.ndarray:
    """255 where Canny finds an edge, one channel."""
    return (canny(np_grey(bgr)) * np.uint8(255))[..., None]


def overlay(bgr: np.ndarray) -> np.ndarray:
    out = bgr.copy()
    out[canny(np_grey(bgr))] = EDGE
    return out


def beside(bgr: np.ndarray) -> np.ndarray:
    return np.concatenate([bgr, overlay(bgr)], axis=1)


def drawn(images: DataFrame, draw: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The images with what ``draw`` makes of their pixels; a failing image gets its error and no pixels, other columns stay."""
    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    made = ("height", "width", "channels", "data", "error")
    kept = [c for c in images.columns if c not in made]

    def one(data: bytes | None, height: int | None, width: int | None, channels: int | None, error: str | None) -> tuple:
        if error is not None:
            return None, None, None, None, error
        try:
            if data is None:
                raise ValueError("the file can't be decoded")
            out = draw(three_channels(data, height or 0, width or 0, channels or 0))
            return *out.shape, out.tobytes(), None
        except Exception as e:  # noqa: BLE001  a bad image is a row, not the end of the job
            return None, None, None, None, f"{type(e).__name__}: {e}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                rows = [one(*values) for values in zip(*(part.column(c).to_pylist() for c in ("data", "height", "width", "channels", "error")), strict=True)]
                cols = [pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, *made])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["height int", "width int", "channels int", "data binary", "error string"])
    return images.mapInArrow(each, schema)


def edge_maps(images: DataFrame) -> DataFrame:
    """Image rows of one channel: 255 at edges, 0 elsewhere."""
    return drawn(images, edge_map)


def overlays(images: DataFrame) -> DataFrame:
    """The images with their edges in yellow."""
    return drawn(images, overlay)


def side_by_side(images: DataFrame) -> DataFrame:
    """Each image with its edges in yellow at its right."""
    return drawn(images, beside)


def caption() -> Column:
    """The lines that go with a comparison: quality, severity, usefulness, value, edges, visibility."""
    return F.concat_ws(
        "\n", F.format_string("Quality: %s (%.1f/100)", "usability_category", "overall_score"), F.format_string("Blue Water Severity: %.1f/10", "blue_water_problem_severity"),
        F.format_string("Feature Usefulness: %.1f/100", "feature_usefulness_score"), F.format_string("Marine Science Value: %.1f/100", "marine_science_value"),
        F.format_string("Edge Density: %.4f", "edge_density"), F.format_string("Visibility: %.3f", "visibility_score"),
    )
