"""Metrics by tiles equal those of whole images, whatever the tiles' side."""

import numpy as np
import pytest

from tidewater.functions.kernels import KERNELS, Image, eme
from tidewater.operators import graph, tiled


def image(h, w, seed):
    """Noise, smooth parts, long lines across tiles and flat fields."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = 120 + 60 * np.sin(x / 9.0) + 40 * np.cos(y / 13.0)
    base[(x + y) % 61 < 2] = 250
    base[h // 3] += 30
    noise = rng.integers(-40, 40, (h, w, 3)) * (x > w // 2)[..., None]
    return np.clip(base[..., None] + noise + np.array([10, 0, -20]), 0, 255).astype(np.uint8)


IMAGES = {"tall": image(131, 67, 1), "wide": image(40, 200, 2), "small": image(9, 12, 3), "line": image(1, 70, 4), "flat": np.full((64, 64, 3), 90, np.uint8), "even": image(128, 96, 5)}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(n, y, x, *map(int, m[y, x])) for n, m in IMAGES.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, b int, g int, r int").repartition(8).persist()


@pytest.mark.parametrize("size", [32, 64, 256])
def test_equals_whole_images(spark, pixels, size):
    got = {r.image_id: r for r in tiled.measure(pixels, size=size).collect()}
    for name, bgr in IMAGES.items():
        whole = Image(bgr)
        own = {"uism": lambda m: eme(m.gradient), "uiconm": Image.uiconm}
        for metric in tiled.METRICS:
            assert got[name][metric] == pytest.approx((own.get(metric) or KERNELS[metric])(whole), rel=1e-9, abs=1e-9), (name, metric, size)


def test_chosen_metrics_and_bad_tiles(spark, pixels):
    found = tiled.measure(pixels.where("image_id = 'small'"), ["edge_density", "uism"], 32)
    assert found.columns == ["image_id", "edge_density", "uism"] and found.count() == 1
    assert tiled.measure(pixels.limit(0), ["edge_density", "blur_estimate", "corner_density"], 32).count() == 0
    with pytest.raises(ValueError):
        tiled.measure(pixels, size=40)
    with pytest.raises(ValueError):
        tiled.measure(pixels, ["rms_contrast"])
    with pytest.raises(Exception, match="missing or repeated"):
        tiled.measure(pixels.where("not (image_id = 'small' and y = 3 and x = 3)"), ["uism"], 32).collect()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (50, 2)) if a != b]
    parent = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == parent
