"""Neighbourhood and whole-image metrics in numpy, each computed once from shared planes.

A kernel sees one decoded image; Spark partitions the images.  Borders are
mirrored without repeating the edge unless a kernel says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

from .colour import np_grey, np_hue, np_lab

EPS = 1e-6
#: Rows of a band: the planes of a band stay in the processor's cache.
BAND = 32
#: Offsets of the 16 pixels around a FAST centre, clockwise from the top (fixed values).
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def mirror(x: np.ndarray, n: int) -> np.ndarray:
    """Mirrored without the edge; a side of one pixel is repeated."""
    for axis in range(2):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (n, n)
        x = np.pad(x, pad, mode="reflect" if x.shape[axis] > 1 else "edge")
    return x


def along(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlation of padded data with taps along one axis; the result is shorter by len(taps) - 1.

    A band of the result is a product of data and a band matrix of the taps, which matrix libraries do
    faster than sums of shifted planes, zeros included.
    """
    more = len(taps) - 1
    n = x.shape[axis] - more
    out = np.empty([n if i == axis else s for i, s in enumerate(x.shape)])
    matrix = np.zeros((BAND + more, BAND))
    for i, tap in enumerate(taps):
        matrix[np.arange(BAND) + i, np.arange(BAND)] = tap
    for start in range(0, n, BAND):
        size = min(BAND, n - start)
        own = matrix[: size + more, :size]
        if axis == 0:
            np.matmul(own.T, x[start : start + size + more], out=out[start : start + size])
        else:
            out[:, start : start + size] = x[:, start : start + size + more] @ own
    return out


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    ones = np.ones(size)
    return along(along(mirror(x, size // 2), ones, 0), ones, 1) / (size * size)


def box_stds(grey: np.ndarray, size: int) -> np.ndarray:
    x = grey.astype(float)
    mean = box_mean(x, size)
    return np.sqrt(np.maximum(box_mean(x * x, size) - mean * mean, 0))


def box_std(grey: np.ndarray, size: int) -> float:
    return float(box_stds(grey, size).mean())


def sobel(grey: np.ndarray, edge: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of 8-bit data along the row and the column, as 16-bit integers."""
    x = grey.astype(np.int16)
    x = mirror(x, 1) if edge == "reflect" else np.pad(x, 1, mode=edge)
    across, down = x[:, 2:] - x[:, :-2], x[2:] - x[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def laplacian(grey: np.ndarray) -> np.ndarray:
    x = mirror(grey.astype(np.int16), 1)
    return x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]


def laplacian_variance(grey: np.ndarray) -> float:
    return float(laplacian(grey).var(dtype=float))


def blur_estimate(grey: np.ndarray) -> float:
    size = np.abs(np.fft.fftshift(np.fft.fft2(grey)))
    h, w = grey.shape
    y, x = np.ogrid[:h, :w]
    low = (x - w // 2) ** 2 + (y - h // 2) ** 2 < (min(h // 2, w // 2) // 4) ** 2
    return float(np.tanh(size[low].sum() / (size[~low].sum() + EPS) / 100))


def thin_edges(grey: np.ndarray, low: int = 50, high: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Masks of weak and of strong edges: Sobel with repeated edges, sums of absolute values, thinning."""
    dx, dy = sobel(grey, "edge")
    size = np.abs(dx) + np.abs(dy)
    pad = np.pad(size, 1)
    at = lambda i, j: pad[1 + i : 1 + i + size.shape[0], 1 + j : 1 + j + size.shape[1]]
    ax, ay = np.abs(dx).astype(np.int32), np.abs(dy).astype(np.int32) * 32768
    flat = ay < ax * 13573
    steep = ay > ax * 13573 + ax * 65536
    falls = (dx < 0) != (dy < 0)
    slant = np.where(falls, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))
    thin = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), slant))
    weak = thin & (size > low)
    return weak, weak & (size > high)


def canny(grey: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Edge mask: the weak edges that strong ones reach, 8-connected."""
    weak, edges = (np.pad(mask, 1) for mask in thin_edges(grey, low, high))
    fresh, width = np.flatnonzero(edges), edges.shape[1]
    flat_edges, waiting = edges.ravel(), (weak & ~edges).ravel()
    while len(fresh):
        found = []
        for step in (-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1):
            near = fresh + step
            near = near[waiting[near]]
            waiting[near] = False
            found.append(near)
        fresh = np.concatenate(found)
        flat_edges[fresh] = True
    return edges[1:-1, 1:-1]


def gaussian_blur(grey: np.ndarray, sigma: float) -> np.ndarray:
    size = int(round(6 * sigma + 1)) | 1
    x = np.arange(size) - size // 2
    taps = np.exp(-(x**2) / (2 * sigma**2))
    taps /= taps.sum()
    padded = grey.astype(float)
    for axis, n in enumerate(grey.shape):  # mirrored as often as a small image needs
        places = np.abs((np.arange(-(size // 2), n + size // 2) + (n - 1)) % max(1, 2 * (n - 1)) - (n - 1))
        padded = along(np.take(padded, places, axis=axis), taps, axis)
    return np.clip(np.rint(padded), 0, 255).astype(np.uint8)


def harris(grey: np.ndarray) -> np.ndarray:
    """The Harris response (2x2 sums, k = 0.04)."""
    dx, dy = (d.astype(float) for d in sobel(grey))

    def box(p: np.ndarray) -> np.ndarray:
        q = mirror(p, 1)[:-1, :-1]
        return q[:-1, :-1] + q[:-1, 1:] + q[1:, :-1] + q[1:, 1:]

    a, b, d = box(dx * dx), box(dx * dy), box(dy * dy)
    return a * d - b * b - 0.04 * (a + d) ** 2


def corner_density(grey: np.ndarray) -> float:
    """Share of pixels whose Harris response exceeds a hundredth of the largest."""
    response = harris(grey)
    return float((response > 0.01 * response.max()).mean())


def keypoints(grey: np.ndarray, threshold: int = 20) -> np.ndarray:
    """FAST corners, without the outer three rows and columns: 9 of 16 in a row all brighter or all darker, strongest of their neighbours."""
    h, w = grey.shape
    if h < 7 or w < 7:
        return np.zeros((max(h - 6, 0), max(w - 6, 0)), bool)
    x = grey.astype(np.int16)
    score = np.empty((h - 6, w - 6), np.int16)
    for start in range(3, h - 3, BAND // 2):
        stop = min(start + BAND // 2, h - 3)
        centre = x[start:stop, 3:-3]
        ring = np.stack([x[start + i : stop + i, 3 + j : w - 3 + j] - centre for i, j in (*CIRCLE, *CIRCLE[:8])])
        runs = []  # the weakest of 9 in a row, for brighter and darker pixels
        for weakest in (np.minimum, np.maximum):
            two = weakest(ring[:-1], ring[1:])
            four = weakest(two[:-2], two[2:])
            runs.append(weakest(weakest(four[:-4], four[4:])[:16], ring[8:]))
        score[start - 3 : stop - 3] = np.maximum(runs[0].max(axis=0), -runs[1].min(axis=0))
    score = np.maximum(score, 0)
    score = np.where(score > threshold, score - 1, 0)
    pad = np.pad(score, 1)
    best = score > 0
    for i in range(3):
        for j in range(3):
            if (i, j) != (1, 1):
                best &= score > pad[i : i + score.shape[0], j : j + score.shape[1]]
    return best


def blocks(x: np.ndarray, size: int, fill: float) -> np.ndarray:
    """(rows, columns, size, size) blocks; the last ones are filled up."""
    h, w = x.shape
    x = np.pad(x, ((0, -h % size), (0, -w % size)), constant_values=fill)
    return x.reshape(x.shape[0] // size, size, x.shape[1] // size, size).swapaxes(1, 2)


def eme_parts(x: np.ndarray, size: int = 8) -> tuple[float, int]:
    """Sum of the log ratios of the largest to the least value of blocks without zeros, and the number of these."""
    x = np.pad(x, [(0, -n % size) for n in x.shape], mode="edge")  # what is repeated changes no block's extremes
    top, low = x[::size].copy(), x[::size].copy()
    for i in range(1, size):
        np.maximum(top, x[i::size], out=top)
        np.minimum(low, x[i::size], out=low)
    top, low = top.reshape(len(top), -1, size).max(axis=2), low.reshape(len(low), -1, size).min(axis=2)
    some = low > 0
    return float(np.log(top[some] / low[some] + EPS).sum()), int(some.sum())


def eme(x: np.ndarray, size: int = 8) -> float:
    """Mean log ratio of the largest to the least value of blocks without zeros."""
    total, n = eme_parts(x, size)
    return total / (n + EPS)


def laplacian_of_gaussian(x: np.ndarray) -> np.ndarray:
    """Sigma 1, radius 4; borders are mirrored with the edge repeated."""
    t = np.arange(-4, 5)
    smooth = np.exp(-(t**2) / 2.0)
    smooth /= smooth.sum()
    bend = (t**2 - 1.0) * smooth
    pad = np.pad(x.astype(float), 4, mode="symmetric")
    return along(along(pad, bend, 0), smooth, 1) + along(along(pad, smooth, 0), bend, 1)


def weber_parts(grey: np.ndarray, rows: int, cols: int, size: int = 32) -> tuple[float, int]:
    """Sum of the contrasts of centre and surround over so many rows and columns of patches, and the number of those that count."""
    if not rows or not cols:
        return 0.0, 0
    patch = blocks(grey[: rows * size, : cols * size].astype(float), size, 0)
    lo, hi = size // 4, 3 * size // 4
    centre = patch[:, :, lo:hi, lo:hi].mean(axis=(2, 3))
    rest = patch.copy()
    rest[:, :, lo:hi, lo:hi] = 0
    n = (rest > 0).sum(axis=(2, 3))
    around = np.where(n > 0, rest.sum(axis=(2, 3)) / np.maximum(n, 1), centre)
    some = around > 1
    return float((np.abs(centre - around)[some] / around[some]).sum()), int(some.sum())


def weber_contrast(grey: np.ndarray, size: int = 32) -> float:
    """Centre against surround of the patches that end before the last row and column."""
    total, n = weber_parts(grey, max(0, (grey.shape[0] - 1) // size), max(0, (grey.shape[1] - 1) // size), size)
    return total / n if n else 0.0


def entropy(histogram: np.ndarray) -> float:
    p = histogram / (histogram.sum() + EPS)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


class Image:
    """A decoded BGR image with the planes that several metrics share, made when first needed."""

    def __init__(self, bgr: np.ndarray) -> None:
        if bgr.ndim != 3 or bgr.shape[2] != 3 or not bgr.size:
            raise ValueError("an image needs rows, columns and three channels")
        self.bgr = bgr
        self.height, self.width = bgr.shape[:2]
        self.area = self.height * self.width

    @cached_property
    def grey(self) -> np.ndarray:
        return np_grey(self.bgr)

    @cached_property
    def lab(self) -> np.ndarray:
        return np_lab(self.bgr)

    @cached_property
    def hue(self) -> np.ndarray:
        return np_hue(self.bgr)

    @cached_property
    def gradient(self) -> np.ndarray:
        dx, dy = (d.astype(np.int32) for d in sobel(self.grey))
        return np.sqrt(dx * dx + dy * dy)

    @cached_property
    def histograms(self) -> list[np.ndarray]:
        return [np.bincount(self.bgr[..., i].ravel(), minlength=256) for i in range(3)]

    @cached_property
    def grey_histogram(self) -> np.ndarray:
        return np.bincount(self.grey.ravel(), minlength=256)

    def uciqe(self) -> float:
        lab = self.lab / 255.0
        light, a, b = lab[..., 0], lab[..., 1] - 128 / 255, lab[..., 2] - 128 / 255
        chroma = np.sqrt(a * a + b * b)
        return float(0.4680 * chroma.std() + 0.2745 * light.std() + 0.2576 * (chroma / (light + EPS)).mean())

    def uiqm(self) -> float:
        b, g, r = (self.bgr[..., i].astype(float) for i in range(3))
        rg, yb = r - g, (r + g) / 2 - b
        uicm = -0.0268 * np.hypot(rg.mean(), yb.mean()) + 0.1586 * np.hypot(rg.std(), yb.std())
        return float(0.0282 * uicm + 0.2953 * eme(self.gradient) + 3.5753 * self.uiconm())

    def uiconm(self) -> float:
        return sum(eme(np.abs(laplacian_of_gaussian(self.bgr[..., i]))) for i in range(3)) / 3

    def uniformity(self, i: int) -> float:
        p = self.histograms[i] / (self.area + EPS)
        return float(((p - 1 / 256) ** 2).sum() / (1 / 256 + EPS))


def _contrast(low: float, top: float) -> float:
    return (top - low) / (top + low + EPS)


#: How each base metric comes from an image.
KERNELS: dict[str, Callable[[Image], float]] = {
    "blue_channel_mean": lambda m: float(m.bgr[..., 0].mean()),
    "green_channel_mean": lambda m: float(m.bgr[..., 1].mean()),
    "red_channel_mean": lambda m: float(m.bgr[..., 2].mean()),
    "rms_contrast": lambda m: float(m.grey.std() / (m.grey.mean() + EPS)),
    "michelson_contrast": lambda m: _contrast(float(m.grey.min()), float(m.grey.max())),
    "local_contrast": lambda m: box_std(m.grey, 15),
    "weber_contrast": lambda m: weber_contrast(m.grey),
    "lab_contrast": lambda m: float(m.lab[..., 0].std() / (m.lab[..., 0].mean() + EPS)),
    "sharpness_laplacian": lambda m: laplacian_variance(m.grey),
    "sharpness_gradient": lambda m: float(m.gradient.mean()),
    "blur_estimate": lambda m: blur_estimate(m.grey),
    "edge_density": lambda m: float(canny(m.grey).mean()),
    "multi_scale_edge_density": lambda m: float(np.mean([canny(gaussian_blur(m.grey, s)).mean() for s in (1.0, 2.0, 4.0)])),
    "corner_density": lambda m: corner_density(m.grey),
    "keypoint_density": lambda m: int(keypoints(m.grey).sum()) / m.area * 1000,
    "texture_complexity": lambda m: box_std(m.grey, 9),
    "uciqe_score": Image.uciqe,
    "uiqm_score": Image.uiqm,
    "entropy_gray": lambda m: entropy(m.grey_histogram),
    "entropy_color": lambda m: float(np.mean([entropy(h) for h in m.histograms])),
    "histogram_uniformity_b": lambda m: m.uniformity(0),
    "histogram_uniformity_g": lambda m: m.uniformity(1),
    "histogram_uniformity_r": lambda m: m.uniformity(2),
    "dynamic_range_b": lambda m: float((m.histograms[0] / (m.area + EPS) > 0.001).sum() / 256),
    "dynamic_range_g": lambda m: float((m.histograms[1] / (m.area + EPS) > 0.001).sum() / 256),
    "dynamic_range_r": lambda m: float((m.histograms[2] / (m.area + EPS) > 0.001).sum() / 256),
    "hue_diversity": lambda m: entropy(np.bincount(m.hue.ravel(), minlength=256)),
}


def shrink(bgr: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted means where a side shrinks, linear interpolation where it grows."""
    out = bgr.astype(float)
    for axis, n in ((0, height), (1, width)):
        old = out.shape[axis]
        if n == old:
            continue
        if n < old:
            total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), out.cumsum(axis=axis)], axis=axis)
            at = np.arange(n + 1) * (old / n)
            whole = np.minimum(at.astype(int), old - 1)
            part = (at - whole).reshape([-1 if i == axis else 1 for i in range(3)])
            sums = np.take(total, whole, axis) + part * np.take(out, whole, axis)
            out = np.diff(sums, axis=axis) / (old / n)
        else:
            at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
            whole = np.minimum(at.astype(int), max(0, old - 2))
            part = (at - whole).reshape([-1 if i == axis else 1 for i in range(3)])
            out = np.take(out, whole, axis) * (1 - part) + np.take(out, np.minimum(whole + 1, old - 1), axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def three_channels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR rows: one channel is repeated, a fourth is dropped."""
    x = np.frombuffer(data, np.uint8)
    if channels not in (1, 3, 4) or height <= 0 or width <= 0 or len(x) != height * width * channels:
        raise ValueError("the image has no pixels or an unknown number of channels")
    x = x.reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., :3]
