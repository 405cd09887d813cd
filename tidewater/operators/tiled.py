"""Neighbourhood metrics of images of any size: tiles with halos, each tile by the kernels of whole images.

A tile's kernel works on its pixels and a halo of ``HALO`` around them, cut at the image's own borders, so that what
it finds for its own pixels is what the whole image gives; sums of tiles are the image's.  Edges are followed
across tiles by components, the spectrum by transforms of rows and then of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.colour import np_grey
from .graph import components
from .stats import written

#: Pixels around a tile that its kernels see; the widest, edges after a blur of sigma 4, need 15.
HALO = 16
#: Tiles are so many pixels wide or multiples of it: blocks of 8 and patches of 32 are never cut.
STEP = 32
#: Rows or columns that one task transforms at once.
BAND = 64
EPS = 1e-6
SCALES = (1.0, 2.0, 4.0)
METRICS = (
    "local_contrast", "weber_contrast", "sharpness_laplacian", "sharpness_gradient", "blur_estimate", "edge_density", "multi_scale_edge_density", "corner_density",
    "keypoint_density", "texture_complexity", "uism", "uiconm",
)


def cut(pixels: DataFrame, size: int = 512) -> DataFrame:
    """Tiles (image_id, height, width, y, x, top, left, rows, cols, data) of pixel rows (image_id, y, x, b, g, r), written.

    A tile owns ``size`` * ``size`` pixels from (y, x); data holds blue, green and red of these and of the halo that the
    image has, ``rows`` * ``cols`` pixels from (top, left).  Each pixel goes to the tiles that see it: four at most where
    tiles are wider than halos.  An image with a missing or repeated pixel raises.
    """
    if size <= 0 or size % STEP:
        raise ValueError(f"the side of a tile has to be a multiple of {STEP}")
    sides = pixels.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    last = lambda c, n: F.floor((F.col(n) - 1) / size)
    seen = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - HALO) / size), F.lit(0)), F.least(F.floor((F.col(c) + HALO) / size), last(c, n))).cast("array<int>"))
    value = F.col("b") + F.col("g") * 256 + F.col("r") * 65536
    dealt = pixels.join(sides, "image_id").select("image_id", "height", "width", "y", "x", value.cast("int").alias("v"), seen("y", "height").alias("i")).select("*", seen("x", "width").alias("j"))

    def one(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        height, width, y, x = first["height"], first["width"], first["i"] * size, first["j"] * size
        top, left = max(0, y - HALO), max(0, x - HALO)
        rows, cols = min(height, y + size + HALO) - top, min(width, x + size + HALO) - left
        at = (table["y"].to_numpy().astype(np.int64) - top) * cols + table["x"].to_numpy() - left
        plane = np.full(rows * cols, -1, np.int32)
        plane[at] = table["v"].to_numpy()
        if len(at) != len(plane) or (plane < 0).any():
            raise ValueError(f"image {first['image_id']} has missing or repeated pixels")
        data = np.stack([plane & 255, plane >> 8 & 255, plane >> 16], axis=1).astype(np.uint8).tobytes()
        own = {"height": height, "width": width, "y": y, "x": x, "top": top, "left": left, "rows": rows, "cols": cols, "data": data}
        return pa.table([table["image_id"].slice(0, 1), *(pa.array([own[c]], pa.binary() if c == "data" else pa.int32()) for c in own)], names=["image_id", *own])

    kind = pixels.schema["image_id"].dataType.simpleString()
    made = dealt.groupBy("image_id", "i", "j").applyInArrow(one, f"image_id {kind}, height int, width int, y int, x int, top int, left int, rows int, cols int, data binary")
    return written(made, "tiles")


class Tile:
    """A tile's pixels with their halo, and where its own lie in them."""

    def __init__(self, r: dict, size: int) -> None:
        self.bgr = np.frombuffer(r["data"], np.uint8).reshape(r["rows"], r["cols"], 3)
        self.grey = np_grey(self.bgr)
        self.height, self.width, self.top, self.left, self.y, self.x = (r[c] for c in ("height", "width", "top", "left", "y", "x"))
        self.down, self.across = self.y - self.top, self.x - self.left
        self.rows, self.cols = min(size, self.height - self.y), min(size, self.width - self.x)

    def own(self, plane: np.ndarray, ring: int = 0) -> np.ndarray:
        """The tile's own part of a plane, with a ring around it where the image goes on."""
        top, left = max(0, self.down - ring), max(0, self.across - ring)
        return plane[top : self.down + self.rows + ring, left : self.across + self.cols + ring]


def mapped(tiles: DataFrame, schema: str, work, *more: str) -> DataFrame:  # noqa: ANN001
    """What ``work(row)`` yields as tuples for each tile; image_id leads them."""
    kind = tiles.schema["image_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a tile at a time: they are large
                row = batch.slice(k, 1)
                out = list(work({n: row.column(n)[0].as_py() for n in row.schema.names if n != "image_id"}))
                ids = row.column("image_id").take(pa.array([0] * len(out), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], names=["image_id", *names])

    return tiles.select("image_id", "height", "width", "y", "x", "top", "left", "rows", "cols", "data", *more).mapInArrow(each, f"image_id {kind}, {schema}")


SUMS = ("local", "texture", "lap", "lap2", "grad", "keys", "eme0", "eme1", "eme2", "eme3", "some0", "some1", "some2", "some3", "weber", "patches")


def partial(tile: Tile, wanted: set[str]) -> dict[str, float]:
    """What a tile adds to the sums of its image, and its largest corner response."""
    out = dict.fromkeys(SUMS, 0.0) | {"corner": 0.0}
    if "local_contrast" in wanted:
        out["local"] = float(tile.own(kernels.box_stds(tile.grey, 15)).sum())
    if "texture_complexity" in wanted:
        out["texture"] = float(tile.own(kernels.box_stds(tile.grey, 9)).sum())
    if "sharpness_laplacian" in wanted:
        bend = tile.own(kernels.laplacian(tile.grey)).astype(np.int64)
        out["lap"], out["lap2"] = float(bend.sum()), float((bend * bend).sum())
    if wanted & {"sharpness_gradient", "uism"}:
        dx, dy = (d.astype(np.int32) for d in kernels.sobel(tile.grey))
        slope = tile.own(np.sqrt(dx * dx + dy * dy))
        out["grad"] = float(slope.sum())
        out["eme3"], out["some3"] = kernels.eme_parts(slope)
    if "uiconm" in wanted:
        for i in range(3):
            out[f"eme{i}"], out[f"some{i}"] = kernels.eme_parts(tile.own(np.abs(kernels.laplacian_of_gaussian(tile.bgr[..., i]))))
    if "keypoint_density" in wanted:
        out["keys"] = float(tile.own(np.pad(kernels.keypoints(tile.grey), 3))[: tile.rows, : tile.cols].sum()) if min(tile.grey.shape) >= 7 else 0.0
    if "weber_contrast" in wanted:
        count = lambda side, at, n: max(0, min((side - 1) // STEP - at // STEP, n // STEP))
        out["weber"], out["patches"] = kernels.weber_parts(tile.own(tile.grey), count(tile.height, tile.y, tile.rows), count(tile.width, tile.x, tile.cols), STEP)
    if "corner_density" in wanted:
        out["corner"] = float(tile.own(kernels.harris(tile.grey)).max())
    return out


def labelled(mask: np.ndarray) -> np.ndarray:
    """For each set pixel of a mask, in their order, the least place (row by row) that is 8-connected with it."""
    at = np.flatnonzero(mask)
    place = np.full(mask.size, -1, np.int64)
    place[at] = np.arange(len(at))
    place = place.reshape(mask.shape)
    pairs = []
    for a, b in ((place[:, :-1], place[:, 1:]), (place[:-1], place[1:]), (place[:-1, :-1], place[1:, 1:]), (place[:-1, 1:], place[1:, :-1])):
        met = (a >= 0) & (b >= 0)
        pairs.append(np.stack([a[met], b[met]]))
    i, j = np.concatenate(pairs, axis=1)
    label = np.arange(len(at))
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != label[label]).any():  # all the way: what isn't a root must not be tied anew
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return at[label]


def edge_counts(tiles: DataFrame, size: int, scale: float | None) -> DataFrame:
    """(image_id, n): pixels of the image's edges, after a blur where there is a scale.

    A tile labels the weak edges of its pixels and of one ring around them.  Pieces of two tiles that hold the same pixel are
    one piece; a piece that holds a strong pixel in any tile is an edge, and every tile counts its own pixels of it.
    """

    def pieces(r: dict) -> Iterator[tuple]:
        tile = Tile(r, size)
        grey = tile.grey if scale is None else kernels.gaussian_blur(tile.grey, scale)
        weak, strong = (tile.own(m, 1) for m in kernels.thin_edges(grey))
        top, left = max(0, tile.y - 1), max(0, tile.x - 1)
        label = labelled(weak)
        at = np.flatnonzero(weak)
        if not len(at):
            return
        y, x = at // weak.shape[1] + top, at % weak.shape[1] + left
        mine = (y >= tile.y) & (y < tile.y + tile.rows) & (x >= tile.x) & (x < tile.x + tile.cols)
        names, of = np.unique(label, return_inverse=True)
        count = np.bincount(of, weights=mine, minlength=len(names))
        hot = np.bincount(of, weights=strong.ravel()[at], minlength=len(names)) > 0
        inner = lambda v, start, n, whole: ((v <= start) & (start > 0)) | ((v >= start + n - 1) & (start + n < whole))
        rim = inner(y, tile.y, tile.rows, tile.height) | inner(x, tile.x, tile.cols, tile.width)
        # a piece is named by its tile and its first pixel there
        name = ((top + names // weak.shape[1]) * tile.width + left + names % weak.shape[1]) * 4 + (top != tile.y) * 2 + (left != tile.x)
        tile_no = tile.y // size * ((tile.width + size - 1) // size) + tile.x // size
        for k in range(len(names)):
            yield tile_no, int(name[k]), int(count[k]), bool(hot[k]), None
        for k in np.flatnonzero(rim):
            yield tile_no, int(name[of[k]]), 0, False, int(y[k] * tile.width + x[k])

    found = written(mapped(tiles, "tile long, piece long, n long, hot boolean, pixel long", pieces), "pieces")
    node = F.xxhash64("image_id", "tile", "piece").alias("node")
    nodes = found.where("pixel is null").select("image_id", node, "n", "hot")
    held = found.where("pixel is not null").select("image_id", "pixel", node)
    first = held.groupBy("image_id", "pixel").agg(F.min("node").alias("a"))
    tied = written(held.join(first, ["image_id", "pixel"]).where("node != a").select("a", F.col("node").alias("b")).distinct(), "ties")
    if tied.isEmpty():
        return nodes.groupBy("image_id").agg(F.sum(F.when(F.col("hot"), F.col("n"))).alias("n"))
    whole = nodes.join(components(tied), "node", "left").withColumn("node", F.coalesce("component", "node"))
    lit = whole.groupBy("image_id", "node").agg(F.sum("n").alias("n"), F.max("hot").alias("hot"))
    return lit.where("hot").groupBy("image_id").agg(F.sum("n").alias("n"))


def spectrum(tiles: DataFrame, size: int) -> DataFrame:
    """(image_id, low, high): sums of the sizes of the Fourier transform inside and outside the disc of low frequencies.

    Rows are put together from their tiles in bands and transformed, then columns in bands: a task
    holds a band, ``BAND`` whole rows or columns at most.
    """
    kind = tiles.schema["image_id"].dataType.simpleString()
    deep = BAND if size % BAND == 0 else STEP

    def strips(r: dict) -> Iterator[tuple]:
        tile = Tile(r, size)
        grey = tile.own(tile.grey)
        for at in range(0, tile.rows, deep):
            yield tile.height, tile.width, (tile.y + at) // deep, tile.x, grey[at : at + deep].tobytes()

    def across(table: pa.Table) -> pa.Table:
        r = table.sort_by("x").to_pylist()
        height, width, band = r[0]["height"], r[0]["width"], r[0]["band"]
        rows = min(deep, height - band * deep)
        made = np.fft.fft(np.concatenate([np.frombuffer(p["part"], np.uint8).reshape(rows, -1) for p in r], axis=1), axis=1)
        starts = range(0, width, BAND)
        cols = [pa.array([v] * len(starts), pa.int32()) for v in (height, width)]
        return pa.table([table["image_id"].take([0] * len(starts)), *cols, pa.array([s // BAND for s in starts], pa.int32()), pa.array([band] * len(starts), pa.int32()), pa.array([np.ascontiguousarray(made[:, s : s + BAND]).tobytes() for s in starts], pa.binary())], names=["image_id", "height", "width", "column", "band", "part"])

    def down(table: pa.Table) -> pa.Table:
        r = table.sort_by("band").to_pylist()
        height, width, column = r[0]["height"], r[0]["width"], r[0]["column"]
        cols = min(BAND, width - column * BAND)
        made = np.abs(np.fft.fft(np.concatenate([np.frombuffer(p["part"], np.complex128).reshape(-1, cols) for p in r]), axis=0))
        y = (np.arange(height) + height // 2) % height - height // 2
        x = (np.arange(column * BAND, column * BAND + cols) + width // 2) % width - width // 2
        disc = y[:, None] ** 2 + x[None, :] ** 2 < (min(height // 2, width // 2) // 4) ** 2
        return pa.table([table["image_id"].slice(0, 1), pa.array([float(made[disc].sum())]), pa.array([float(made[~disc].sum())])], names=["image_id", "low", "high"])

    bands = mapped(tiles, "height int, width int, band int, x int, part binary", strips)
    rows = bands.groupBy("image_id", "band").applyInArrow(across, f"image_id {kind}, height int, width int, column int, band int, part binary")
    return rows.groupBy("image_id", "column").applyInArrow(down, f"image_id {kind}, low double, high double").groupBy("image_id").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))


def measure(pixels: DataFrame, metrics: Sequence[str] = METRICS, size: int = 512) -> DataFrame:
    """(image_id, metrics...) of pixel rows (image_id, y, x, b, g, r), of images of any size; ``uism`` and ``uiconm`` are the parts of uiqm_score.

    The same values as the kernels of whole images, whatever the tiles' ``size``.  No task holds more than a tile with its
    halo, or a band of rows or columns for the spectrum.
    """
    wanted = set(metrics)
    if wanted - set(METRICS):
        raise ValueError(f"no such metrics here: {sorted(wanted - set(METRICS))}")
    tiles = cut(pixels, size)
    named = ("image_id", *SUMS, "corner")
    sums = mapped(tiles, ", ".join(f"{c} double" for c in named[1:]), lambda r: [tuple(partial(Tile(r, size), wanted).values())])
    area = tiles.groupBy("image_id").agg((F.first("height").cast("double") * F.first("width")).alias("area"))
    found = sums.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("corner").alias("corner")).join(area, "image_id")
    if "corner_density" in wanted:
        found = written(found, "sums")
        limit = found.select("image_id", (F.col("corner") * 0.01).alias("limit"))
        again = mapped(tiles.join(limit, "image_id"), "corners long", lambda r: [(int((tile.own(kernels.harris(tile.grey)) > r["limit"]).sum()),) for tile in [Tile(r, size)]], "limit")
        found = found.join(again.groupBy("image_id").agg(F.sum("corners").alias("corners")), "image_id")
    edges = {"edges": None} if "edge_density" in wanted else {}
    edges |= {f"edges{i}": s for i, s in enumerate(SCALES)} if "multi_scale_edge_density" in wanted else {}
    for name, scale in edges.items():
        found = found.join(edge_counts(tiles, size, scale).withColumnRenamed("n", name), "image_id", "left")
    if "blur_estimate" in wanted:
        found = found.join(spectrum(tiles, size), "image_id")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean: dict[str, Column] = {
        "local_contrast": F.col("local") / F.col("area"), "texture_complexity": F.col("texture") / F.col("area"), "sharpness_gradient": F.col("grad") / F.col("area"),
        "sharpness_laplacian": F.col("lap2") / F.col("area") - (F.col("lap") / F.col("area")) * (F.col("lap") / F.col("area")),
        "weber_contrast": F.when(F.col("patches") > 0, F.col("weber") / F.col("patches")).otherwise(0.0), "keypoint_density": F.col("keys") / F.col("area") * 1000,
        "uism": F.col("eme3") / (F.col("some3") + EPS), "uiconm": (F.col("eme0") / (F.col("some0") + EPS) + F.col("eme1") / (F.col("some1") + EPS) + F.col("eme2") / (F.col("some2") + EPS)) / 3,
    }
    if "corner_density" in wanted:
        mean["corner_density"] = F.col("corners") / F.col("area")
    if "edge_density" in wanted:
        mean["edge_density"] = some("edges") / F.col("area")
    if "multi_scale_edge_density" in wanted:
        mean["multi_scale_edge_density"] = (some("edges0") + some("edges1") + some("edges2")) / 3 / F.col("area")
    if "blur_estimate" in wanted:
        mean["blur_estimate"] = F.tanh(F.col("low") / (F.col("high") + EPS) / 100)
    return found.select("image_id", *[mean[m].alias(m) for m in metrics])
