"""Uncompressed videos as frame rows and back: a Spark data source for Y4M and AVI files.

Where every frame of a file is as long, its frames' places follow from the header, so that a
task seeks to its own frames and no other bytes are read.  Compressed videos need a codec, which
is not here.
"""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import Staged, listed, opened, qualified

ENDINGS = (".y4m", ".avi")
#: The rate of a video that names none (a fixed value).
DEFAULT_RATE = 30.0
#: Bytes of frames that one task reads.
SPLIT = 64 << 20
#: Frames of one file of those that are written; a longer video is several files.
SEGMENT = 10_000
SCHEMA = "path string, frame_idx long, fps double, total_frames long, height int, width int, channels int, data binary, error string"


@dataclass
class Clip:
    """Where a file's frames are and how they are to be read."""

    path: str
    height: int = 0
    width: int = 0
    fps: float = 0.0
    kind: str = ""
    size: int = 0
    places: Sequence[int] = ()
    error: str | None = None


def rate(number: float, what: str) -> float:
    if number > 0:
        return number
    warnings.warn(f"{what} names no rate of frames, {DEFAULT_RATE:g} is taken", stacklevel=2)
    return DEFAULT_RATE


#: Bytes of a Y4M frame by the colour space's name: luma alone, or with two planes of a part of the pixels.
Y4M_KINDS = {"mono": "mono", "444": "444", "422": "422", "420": "420", "420jpeg": "420", "420mpeg2": "420", "420paldv": "420"}


def y4m_size(kind: str, height: int, width: int) -> int:
    planes = {"mono": (0, 0), "444": (height, width), "422": (height, (width + 1) // 2), "420": ((height + 1) // 2, (width + 1) // 2)}[kind]
    return height * width + 2 * planes[0] * planes[1]


def y4m(file: pa.NativeFile, path: str) -> Clip:
    head = file.read_at(4096, 0)
    end = head.find(b"\n")
    if end < 0:
        raise ValueError("the header has no end")
    said = {w[:1]: w[1:] for w in head[:end].decode("ascii", "replace").split(" ")[1:] if w}
    height, width = int(said["H"]), int(said["W"])
    kind = Y4M_KINDS.get(said.get("C", "420"))
    if kind is None or height <= 0 or width <= 0:
        raise ValueError(f"colour space {said.get('C')} is not known")
    top, _, below = said.get("F", "0:1").partition(":")
    fps = rate(int(top) / max(int(below or 1), 1) if int(below or 1) else 0.0, path)
    size, at, places = y4m_size(kind, height, width), end + 1, []
    length = file.size()
    if length > at and file.read_at(6, at) == b"FRAME\n" and (length - at) % (size + 6) == 0 and file.read_at(6, length - size - 6) == b"FRAME\n":
        places = range(at + 6, length, size + 6)
    else:  # frames with parameters of their own, or a file that was cut off
        while at < length:
            mark = file.read_at(256, at)
            if not mark.startswith(b"FRAME") or b"\n" not in mark:
                raise ValueError(f"no frame begins at byte {at}")
            at += mark.index(b"\n") + 1
            places.append(at)
            at += size
    return Clip(path, height, width, fps, kind, size, places)


def chunks(file: pa.NativeFile, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, place, size) of the RIFF chunks between two places."""
    while at + 8 <= end:
        kind, size = struct.unpack("<4sI", file.read_at(8, at))
        yield kind, at + 8, size
        at += 8 + size + size % 2


def avi(file: pa.NativeFile, path: str) -> Clip:
    height = width = depth = 0
    fps, squeezed, places, size, length = 0.0, 0, [], 0, file.size()
    for kind, at, n in [c for kind, at, n in chunks(file, 0, length) if kind == b"RIFF" for c in chunks(file, at + 4, min(at + n, length))]:
        what = file.read_at(4, at) if kind == b"LIST" else b""
        if what == b"hdrl":
            for inner, place, m in chunks(file, at + 4, at + n):
                if inner == b"avih":
                    micro = struct.unpack("<I", file.read_at(4, place))[0]
                    fps = fps or (1e6 / micro if micro else 0.0)
                elif inner == b"LIST":
                    own = {k: (p, s) for k, p, s in chunks(file, place + 4, place + m)}
                    if b"strh" in own and b"strf" in own and file.read_at(4, own[b"strh"][0]) == b"vids":
                        step, per = struct.unpack("<II", file.read_at(8, own[b"strh"][0] + 20))
                        fps = per / step if step and per else fps
                        _, width, height, _, depth, squeezed = struct.unpack("<IiiHHI", file.read_at(20, own[b"strf"][0]))
        elif what == b"movi":
            size = (width * depth // 8 + 3) // 4 * 4 * abs(height)
            first, end = at + 4, min(at + n, length)
            step = 8 + size + size % 2
            same = size and end > first and (end - first) % step == 0 and all(file.read_at(8, p)[2:] == b"db" + struct.pack("<I", size) for p in {first, end - step})
            if same:
                places.extend(range(first + 8, end, step))
            else:
                places.extend(p for k, p, m in chunks(file, first, end) if k[2:] in (b"db", b"dc") and m)
    if squeezed or depth not in (8, 24, 32) or not width or not height:
        raise ValueError("only AVI files of uncompressed frames of 8, 24 or 32 bits can be read")
    return Clip(path, height, width, rate(fps, path), f"avi{depth}", size, places)


def clip_of(system: pafs.FileSystem, path: str) -> Clip:
    """What a file holds; a file that can't be read, or has no frames, is a clip with an error."""
    try:
        with system.open_input_file(path) as file:
            start = file.read_at(10, 0)
            found = y4m(file, path) if start.startswith(b"YUV4MPEG2 ") else avi(file, path) if start.startswith(b"RIFF") else None
        if found is None:
            raise ValueError("it is neither a Y4M nor an AVI file")
        if not len(found.places):
            raise ValueError("it has no frames")
        return found
    except (ValueError, KeyError, struct.error, OSError) as e:
        return Clip(path, error=f"{type(e).__name__}: {e}")


def from_yuv(raw: bytes, kind: str, height: int, width: int) -> bytes:
    """BGR of a Y4M frame: BT.601, video range, chroma repeated; luma alone is taken as it is."""
    plane = np.frombuffer(raw, np.uint8)
    luma = plane[: height * width].reshape(height, width)
    if kind == "mono":
        return np.repeat(luma[..., None], 3, axis=2).tobytes()
    h, w = (height if kind != "420" else (height + 1) // 2), (width if kind == "444" else (width + 1) // 2)
    y = 1.164383 * (luma.astype(np.float64) - 16)
    u, v = (np.repeat(np.repeat(p.reshape(h, w), -(-height // h), axis=0), -(-width // w), axis=1)[:height, :width].astype(np.float64) - 128 for p in (plane[height * width : height * width + h * w], plane[height * width + h * w :]))
    bgr = np.stack([y + 2.017232 * u, y - 0.391762 * u - 0.812968 * v, y + 1.596027 * v], axis=2)
    return np.clip(np.rint(bgr), 0, 255).astype(np.uint8).tobytes()


def from_dib(raw: bytes, depth: int, height: int, width: int) -> bytes:
    """BGR of an AVI frame: rows end on four bytes and begin at the bottom unless the height is negative."""
    rows = np.frombuffer(raw, np.uint8).reshape(abs(height), -1)[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    rows = rows[::-1] if height > 0 else rows
    return np.repeat(rows, 3, axis=2).tobytes() if depth == 8 else np.ascontiguousarray(rows[..., :3]).tobytes()


@dataclass
class Frames:
    """Some frames of a clip: their numbers and places."""

    clip: Clip
    total: int
    numbers: range
    places: list[int] = field(default_factory=list)


@dataclass
class Share(InputPartition):
    """What one task reads: frames of one clip or of several short ones."""

    frames: list[Frames] = field(default_factory=list)


class ClipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.every, self.most = options.get("path"), max(1, int(options.get("every", 1))), int(options.get("max_frames", 0))

    def partitions(self) -> list[Share]:
        """Frames of files, dealt before any of them is read: every n-th, the first so many of these, as many in a task as ``SPLIT`` holds."""
        system, files, alone = listed(self.path, ENDINGS)
        out, room = [Share()], SPLIT
        for file in files:
            clip = clip_of(system, file)
            if alone and clip.error:
                raise ValueError(f"{file}: {clip.error}")
            places, clip.places = clip.places, ()
            numbers, most = range(0, len(places), self.every)[: self.most or None], max(1, SPLIT // max(1, clip.size))
            for at in range(0, max(1, len(numbers)), most):
                part = numbers[at : at + most]
                cost = max(1, len(part)) * clip.size + (1 << 16)  # what it takes to open a file counts as well
                if cost > room and out[-1].frames:
                    out.append(Share())
                    room = SPLIT
                room -= cost
                out[-1].frames.append(Frames(clip, len(places), part, [places[i] for i in part]))
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        names = ["path", "frame_idx", "fps", "total_frames", "height", "width", "channels", "data", "error"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        system, _ = opened(self.path)
        for own in partition.frames:
            for values in frame_rows(system, own):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def frame_rows(system: pafs.FileSystem, own: Frames) -> Iterator[tuple]:
    """The rows of some frames of a clip, or of its error."""
    clip = own.clip
    if clip.error:
        yield clip.path, None, None, None, None, None, None, None, clip.error
        return
    with system.open_input_file(clip.path) as file:
        for i, at in zip(own.numbers, own.places, strict=True):
            raw = file.read_at(clip.size, at)
            common = (clip.path, i, clip.fps, own.total)
            if len(raw) < clip.size:
                yield *common, None, None, None, None, "the frame is cut off"
                continue
            data = from_dib(raw, int(clip.kind[3:]), clip.height, clip.width) if clip.kind.startswith("avi") else from_yuv(raw, clip.kind, clip.height, clip.width)
            yield *common, abs(clip.height), clip.width, 3, data, None


def avi_head(height: int, width: int, frames: int, fps: float) -> bytes:
    """All of an AVI file of 24-bit frames before its first frame."""
    size = (width * 3 + 3) // 4 * 4 * height
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body
    head = struct.pack("<14I", round(1e6 / fps), 0, 0, 0, frames, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = b"vidsDIB " + struct.pack("<IHHI", 0, 0, 0, 0) + struct.pack("<IIIIIII4H", 1_000_000, round(fps * 1_000_000), 0, frames, size, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    listed_ = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    body = 4 + frames * (8 + size + size % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(listed_) + 8 + body) + b"AVI " + listed_ + b"LIST" + struct.pack("<I", body) + b"movi"


@dataclass
class Written(WriterCommitMessage):
    made: tuple[str, list[str]]


class ClipWriter(DataSourceArrowWriter):
    """Rows (file, frames, fps, height, width, data), sorted by file, to one AVI file each; frames go straight to the file."""

    def __init__(self, options: dict) -> None:
        self.stage = Staged(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self.stage.begin()
        file, name, left, shape = None, None, 0, None
        for batch in iterator:
            for r in batch.to_pylist():
                if r["file"] != name:
                    if file:
                        file.close()
                    name, left, shape = r["file"], r["frames"], (r["height"], r["width"])
                    if 4 + left * (8 + (shape[1] * 3 + 3) // 4 * 4 * shape[0]) > 0xFFFFFF00:
                        raise ValueError(f"{name} would have over 4 GB; take shorter segments")
                    file = self.stage.file(name)
                    file.write(avi_head(*shape, left, r["fps"]))
                if (r["height"], r["width"]) != shape or len(r["data"]) != shape[0] * shape[1] * 3:
                    raise ValueError(f"the frames of {name} differ in size or have other than three channels")
                rows = np.frombuffer(r["data"], np.uint8).reshape(shape[0], -1)[::-1]
                rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
                file.write(b"00db" + struct.pack("<I", rows.size) + rows.tobytes())
        if file:
            file.close()
        return Written(self.stage.done())

    def commit(self, messages: list[Written | None]) -> None:
        self.stage.settle([m.made for m in messages if m])

    def abort(self, messages: list[Written | None]) -> None:
        self.stage.drop()


class ClipSource(DataSource):
    """Options: path (a file, or a folder with its subfolders), every (1), max_frames (all)."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ClipReader:  # noqa: ANN001
        return ClipReader(self.options)

    def writer(self, schema, overwrite: bool) -> ClipWriter:  # noqa: ANN001
        return ClipWriter(self.options)


def read_clips(spark: SparkSession, path: str, every: int = 1, max_frames: int | None = None) -> DataFrame:
    """Frames (path, video_id, frame_idx, t, fps, total_frames, height, width, channels, data, error) of a video file or of all in a folder.

    Every ``every``-th frame from the first, at most ``max_frames`` of these from each file; the others are not
    read.  A rate that is missing or not positive is 30, with a warning.  A missing path raises, and so does
    a single file that can't be read or has no frames; in a folder it is a row with an error. A frame that is cut off is one too.
    video_id is the file's name without its ending.
    """
    spark.dataSource.register(ClipSource)
    rows = spark.read.format("clips").option("path", qualified(spark, path)).option("every", every).option("max_frames", max_frames or 0).load()
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select("path", name.alias("video_id"), "frame_idx", (F.col("frame_idx") / F.col("fps")).alias("t"), "fps", "total_frames", "height", "width", "channels", "data", "error")


def write_clips(frames: DataFrame, path: str, fps: float = DEFAULT_RATE, segment: int = SEGMENT) -> None:
    """Write frames (video_id, frame_idx, height, width, data of three channels) as AVI files of uncompressed frames, in the order of frame_idx.

    A video of more than ``segment`` numbers of frames is several files, ``<video_id>_<part>.avi`` (parts of four digits); one of
    fewer is ``<video_id>.avi``.  Frames without data are left out.  Tasks write beside the folder; files
    appear when all tasks are done, and none if one fails.
    """
    spark = frames.sparkSession
    spark.dataSource.register(ClipSource)
    rows = frames.where("data is not null").withColumn("part", F.floor(F.col("frame_idx") / segment).cast("long"))
    counts = rows.groupBy("video_id", "part").agg(F.count("*").alias("frames"))
    parts = counts.groupBy("video_id").agg(F.max("part").alias("last"))
    number = F.when(F.col("last") == 0, "").otherwise(F.format_string("_%04d", "part"))
    told = rows.join(counts.join(parts, "video_id"), ["video_id", "part"])
    out = told.select(F.concat(F.col("video_id").cast("string"), number, F.lit(".avi")).alias("file"), "frame_idx", "frames", F.lit(float(fps)).alias("fps"), "height", "width", "data")
    out.repartition("file").sortWithinPartitions("file", "frame_idx").select("file", "frames", "fps", "height", "width", "data").write.format("clips").mode("append").option("path", qualified(spark, path)).save()
