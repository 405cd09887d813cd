"""Image files, frames and arrays as image rows (path, height, width, channels, data, error)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that count as images, in lower case (fixed values).
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")


#: The same as a pattern for files' names in any case, for Spark's readers.
PATTERN = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"


def find_images(spark: SparkSession, path: str, recursive: bool = False, skip: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of the image files of a folder, by extension in any case.

    Only metadata is read.  Files whose name contains ``skip`` are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "modificationTime", "length")
    if skip:
        files = files.where(~F.element_at(F.split("path", "/"), -1).contains(skip))
    return files.orderBy("path")


def _decoded(image: DataFrame) -> DataFrame:
    """Image rows of what Spark's reader gives; what it could not decode has an error."""
    bad = F.col("image.nChannels") <= 0
    value = lambda c: F.when(~bad, F.col(f"image.{c}"))
    return image.select(
        F.col("image.origin").alias("path"), value("height").alias("height"), value("width").alias("width"), value("nChannels").alias("channels"), value("data").alias("data"),
        F.when(bad, "the file can't be decoded").alias("error"),
    )


def read_images(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Decode image files, by the extension in any case; a file that can't be decoded is a row with an error, others are never read."""
    reader = spark.read.format("image").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "false")
    return _decoded(reader.load(path if isinstance(path, str) else list(path)))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as an image, whatever its name."""
    return _decoded(spark.read.format("image").option("dropInvalid", "false").load(path))


def is_folder(spark: SparkSession, path: str) -> bool | None:
    """Whether a path is a folder; None if there is nothing."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(where).isDirectory() if system.exists(where) else None


def read_paths(spark: SparkSession, paths: Sequence[str], folders: Sequence[bool | None] | None = None, recursive: bool = False) -> DataFrame:
    """Files and folders in the order of the arguments: (arg_pos, path, ...); files are taken whatever their name.

    ``folders`` tells which of the paths are folders, None of it which don't exist; unless given, it is looked up.  A path
    that doesn't exist is left out with a warning; if none does, that is an error.
    """
    parts = []
    for i, path in enumerate(paths):
        folder = is_folder(spark, path) if folders is None else folders[i]
        if folder is None:
            warnings.warn(f"{path} was not found, it is left out", stacklevel=2)
            continue
        rows = read_images(spark, path, recursive) if folder else read_file(spark, path)
        parts.append(rows.select(F.lit(i).alias("arg_pos"), "*"))
    if not parts:
        raise FileNotFoundError("none of the paths was found")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def surveys(spark: SparkSession, root: str) -> DataFrame:
    """All images below a folder with the name of the subfolder as ``survey``: one job for all surveys."""
    return read_images(spark, root, recursive=True).withColumn("survey", F.element_at(F.split("path", "/"), -2))


def from_arrays(arrays: DataFrame, key: str, blue: str = "b", green: str = "g", red: str = "r") -> DataFrame:
    """Images from rows with one array of values (0 to 255) per channel, and height and width."""
    triple = F.transform(F.arrays_zip(F.col(blue).alias("b"), F.col(green).alias("g"), F.col(red).alias("r")), lambda p: F.concat(*[F.lpad(F.hex(p[n].cast("int")), 2, "0") for n in "bgr"]))
    return arrays.select(F.col(key).cast("string").alias("path"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.lit(3).alias("channels"), F.unhex(F.array_join(triple, "")).alias("data"), F.lit(None).cast("string").alias("error"))


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Images from pixel rows (image_id, y, x, b, g, r); an image with a missing or repeated pixel is an error row."""
    rows = pixels.groupBy("image_id").agg(
        (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("y", "x", F.concat(*[F.lpad(F.hex(F.col(c).cast("int")), 2, "0") for c in "bgr"]).alias("h")))).alias("p"),
    )
    whole = F.col("n") == F.col("height") * F.col("width")
    return rows.select(
        F.col("image_id").cast("string").alias("path"), "height", "width", F.lit(3).alias("channels"), F.when(whole, F.unhex(F.array_join("p.h", ""))).alias("data"),
        F.when(~whole, "pixels are missing or repeated").alias("error"),
    )


def to_pixels(images: DataFrame) -> DataFrame:
    """Pixel rows (image_id, y, x, b, g, r) of three-channel images, without Python."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("p") * 3 + k + 1, F.lit(1))), 16, 10).cast("int")
    rows = images.where("error is null and channels = 3").select(F.col("path").alias("image_id"), "width", "data", at.alias("p", "_"))
    return rows.select("image_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))


def frames_of(images: DataFrame, pattern: str = r"(\d+)\.[^./]+$") -> DataFrame:
    """An image sequence as frames: video_id is the folder, frame_idx the number in the file's name."""
    return images.withColumns({"video_id": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "frame_idx": F.regexp_extract("path", pattern, 1).cast("long")})


def checked_frames(frames: DataFrame, fps: str = "fps") -> DataFrame:
    """Frames with a usable rate: where it is missing or not positive, 30."""
    return frames.withColumn(fps, F.when(F.col(fps) > 0, F.col(fps)).otherwise(30.0))
