"""8-bit colour conversions: as column expressions and as numpy functions of the same numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of R, G and B in grey, in 1/32768 (fixed values).
GREY = (9798, 19235, 3735)
#: Linear sRGB to XYZ over the D65 white point (fixed values).
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def grey(b: Column, g: Column, r: Column) -> Column:
    wr, wg, wb = GREY
    return F.shiftright(r * wr + g * wg + b * wb + 16384, 15)


def hue(b: Column, g: Column, r: Column) -> Column:
    """0 to 179; grey pixels have 0."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    diff = v - low
    raw = F.when(v == r, g - b).when(v == g, b - r + 2 * diff).otherwise(r - g + 4 * diff)
    step = F.rint(F.lit(122880.0) / F.greatest(diff, F.lit(1)))
    h = F.when(diff == 0, F.lit(0.0)).otherwise(F.floor((raw * step + 2048) / 4096).cast("double"))
    return F.when(h < 0, h + 180).otherwise(h).cast("int")


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """L, a and b in 0 to 255; the last two are moved by 128."""
    def linear(x: Column) -> Column:
        x = x / F.lit(255.0)
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def f(x: Column) -> Column:
        return F.when(x > 0.008856, F.cbrt(x)).otherwise(7.787 * x + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    fx, fy, fz = (f((m[0] * lr + m[1] * lg + m[2] * lb) / w) for m, w in zip(XYZ, WHITE, strict=True))
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5).cast("int")))
    return byte((116 * fy - 16) * 2.55), byte(500 * (fx - fy) + 128), byte(200 * (fy - fz) + 128)


def np_grey(bgr: np.ndarray) -> np.ndarray:
    x = bgr.astype(np.int32)
    return ((x[..., 2] * GREY[0] + x[..., 1] * GREY[1] + x[..., 0] * GREY[2] + 16384) >> 15).astype(np.uint8)


#: Step of the hue by the difference of the largest and the least channel.
_STEPS = np.rint(122880.0 / np.maximum(np.arange(256), 1)).astype(np.int32)


def np_hue(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    diff = v - np.minimum(np.minimum(b, g), r)
    raw = np.where(v == r, g - b, np.where(v == g, b - r + 2 * diff, r - g + 4 * diff))
    h = (raw * _STEPS[diff] + 2048) >> 12  # no difference: raw is 0, and so is the hue
    return np.where(h < 0, h + 180, h).astype(np.uint8)


_POWERS = np.where(np.arange(256) / 255.0 <= 0.04045, np.arange(256) / 255.0 / 12.92, ((np.arange(256) / 255.0 + 0.055) / 1.055) ** 2.4)


def cube_root(x: np.ndarray) -> np.ndarray:
    """Cube roots of numbers from 0.001 to 2, to 13 digits: a third of the exponent and two steps of Halley's rule."""
    y = (x.astype(np.float32).view(np.int32) // 3 + 709921077).view(np.float32).astype(np.float64)
    for _ in range(2):
        cube = y * y * y
        y *= (cube + 2 * x) / (2 * cube + x)
    return y


def np_lab(bgr: np.ndarray) -> np.ndarray:
    out = np.empty(bgr.shape, np.uint8)

    def f(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0.008856, cube_root(x), 7.787 * x + 16.0 / 116.0)

    def byte(x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(x + 0.5), 0, 255)

    for row in range(0, len(bgr), 32):  # bands of rows stay in the processor's cache
        lb, lg, lr = (_POWERS[bgr[row : row + 32, :, i]] for i in range(3))
        fx, fy, fz = (f((m[0] * lr + m[1] * lg + m[2] * lb) / w) for m, w in zip(XYZ, WHITE, strict=True))
        part = out[row : row + 32]
        part[..., 0], part[..., 1], part[..., 2] = byte((116 * fy - 16) * 2.55), byte(500 * (fx - fy) + 128), byte(200 * (fy - fz) + 128)
    return out
