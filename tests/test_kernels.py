"""Metrics of images with known answers."""

import numpy as np
import pytest

from tidewater.functions.kernels import KERNELS, Image, canny, eme, keypoints, shrink, three_channels, weber_contrast


def solid(v, side=64):
    return np.full((side, side, 3), v, np.uint8)


def test_constant_image_is_finite_and_flat():
    m = Image(solid(128))
    got = {n: k(m) for n, k in KERNELS.items()}
    assert all(np.isfinite(v) for v in got.values())
    assert got["rms_contrast"] == got["sharpness_laplacian"] == got["edge_density"] == got["corner_density"] == got["keypoint_density"] == 0
    assert got["uciqe_score"] < 0.05 and got["blur_estimate"] > 0.99


def test_michelson_does_not_overflow():
    x = solid(1)
    x[:, :32] = 255
    assert 0.99 < KERNELS["michelson_contrast"](Image(x)) <= 1


def test_step_edge():
    x = np.zeros((40, 40), np.uint8)
    x[:, 20:] = 200
    assert canny(x).sum() == 40 and set(np.flatnonzero(canny(x).any(axis=0))) <= {19, 20}


def test_one_bright_dot_is_one_keypoint():
    x = np.zeros((20, 20), np.uint8)
    x[10, 10] = 200
    assert keypoints(x).sum() == 1 and keypoints(x[:6]).sum() == 0


def test_histogram_metrics_ignore_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (32, 32, 3)).astype(np.uint8)
    y = rng.permutation(x.reshape(-1, 3)).reshape(x.shape)
    for n in ("entropy_gray", "histogram_uniformity_b", "dynamic_range_g", "hue_diversity", "uciqe_score"):
        assert KERNELS[n](Image(x)) == pytest.approx(KERNELS[n](Image(y)))


def test_small_and_odd_images():
    for shape in ((1, 1), (1, 9), (7, 3), (33, 33)):
        m = Image(np.random.default_rng(1).integers(0, 256, (*shape, 3)).astype(np.uint8))
        assert all(np.isfinite(k(m)) for k in KERNELS.values())
    assert weber_contrast(np.zeros((32, 32), np.uint8)) == 0.0
    assert eme(np.zeros((9, 9))) == 0.0


def test_shrink_and_channels():
    assert (shrink(solid(7), 20, 30) == 7).all() and shrink(solid(7), 20, 30).shape == (20, 30, 3)
    assert shrink(np.array([[[0, 0, 0], [100, 100, 100]]], np.uint8), 1, 1)[0, 0, 0] == 50
    assert three_channels(bytes([1, 2]), 1, 2, 1).tolist() == [[[1, 1, 1], [2, 2, 2]]]
    assert three_channels(bytes([1, 2, 3, 9]), 1, 1, 4).tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        three_channels(b"123", 2, 2, 3)


def test_fast_parts_equal_plain_ones():
    from tidewater.functions import kernels
    from tidewater.functions.colour import cube_root

    x = np.linspace(0.001, 2, 100_001)
    assert np.abs(cube_root(x) / np.cbrt(x) - 1).max() < 1e-12
    rng = np.random.default_rng(6)
    for h, w in ((1, 1), (7, 70), (40, 33), (100, 16)):
        plane = rng.random((h, w)) * (rng.random((h, w)) > 0.02)
        taps = rng.random(min(h, w))
        for axis in (0, 1):
            n = plane.shape[axis] - len(taps) + 1
            want = sum(t * np.take(plane, range(i, i + n), axis=axis) for i, t in enumerate(taps))
            assert kernels.along(plane, taps, axis) == pytest.approx(want, abs=1e-12)
        parts = [plane[i : i + 8, j : j + 8] for i in range(0, h, 8) for j in range(0, w, 8)]
        logs = [np.log(p.max() / p.min() + 1e-6) for p in parts if p.min() > 0]
        assert kernels.eme_parts(plane) == (pytest.approx(sum(logs)), len(logs))
