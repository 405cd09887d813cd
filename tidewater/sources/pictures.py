"""Image rows as PNG files: a Spark data sink whose files appear when all of its tasks are done."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import Staged, qualified


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of 8-bit pixels: grey, or blue, green, red and opacity in that order."""
    if channels not in (1, 3, 4) or height <= 0 or width <= 0 or len(data) != height * width * channels:
        raise ValueError("the image has no pixels or an unknown number of channels")
    rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rows = rows if channels == 1 else rows[..., [2, 1, 0, 3][:channels]]
    lines = np.zeros((height, 1 + width * channels), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


@dataclass
class Written(WriterCommitMessage):
    made: tuple[str, list[str]]


class PictureWriter(DataSourceArrowWriter):
    """Rows (folder, file, height, width, channels, data), one file each."""

    def __init__(self, options: dict) -> None:
        self.stage = Staged(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self.stage.begin()
        for batch in iterator:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                with self.stage.file(r["file"], r["folder"]) as file:
                    file.write(png(r["data"], r["height"], r["width"], r["channels"]))
        return Written(self.stage.done())

    def commit(self, messages: list[Written | None]) -> None:
        self.stage.settle([m.made for m in messages if m])

    def abort(self, messages: list[Written | None]) -> None:
        self.stage.drop()


class PictureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return "folder string, file string, height int, width int, channels int, data binary"

    def writer(self, schema, overwrite: bool) -> PictureWriter:  # noqa: ANN001
        return PictureWriter(self.options)


def write_pictures(images: DataFrame, path: str, name: Column | str = "path", folder: Column | None = None) -> None:
    """Write image rows as PNG files into a folder; ``name`` is each file's name, of which the ending becomes .png.

    ``folder`` names a subfolder for each row (null: none), so that one pass over the images fills all of them.

    Rows without pixels (failures) are left out.  Tasks write beside the folder and files get their names when all are done; a task that is
    run twice leaves one file, and a failed job none.  Two rows of one name are an error.
    """
    images.sparkSession.dataSource.register(PictureSink)
    last = F.element_at(F.split(F.col(name) if isinstance(name, str) else name, "/"), -1)
    file = F.concat(F.regexp_replace(last, r"\.(?i:jpe?g|png|bmp|tiff?)$", ""), F.lit(".png"))
    rows = images.where("data is not null").select((F.lit(None) if folder is None else folder).cast("string").alias("folder"), file.alias("file"), "height", "width", "channels", "data")
    rows.write.format("pictures").mode("append").option("path", qualified(images.sparkSession, path)).save()
