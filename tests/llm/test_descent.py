"""NN-descent against brute force: noise groups, tight groups, copies, nulls."""

import numpy as np
import pytest

from tidewater.llm import descent


def brute(rows, threshold=0.9):
    good = [(i, v) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in good], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = np.array([i for i, _ in good])
    while True:
        then = np.array([min([root[a], *root[linked[a]]]) for a in range(len(good))])
        if (then == root).all():
            break
        root = then
    out = {i: (0, i, True) for i, _ in rows}
    out |= {i: (int(linked[a].sum()), int(root[a]), bool(root[a] == i)) for a, (i, _) in enumerate(good)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((600, 16))
    loose = rng.standard_normal(16) + 0.22 * rng.standard_normal((90, 16))  # about 0.95 and less to each other
    tight = rng.standard_normal(16) + 0.03 * rng.standard_normal((200, 16))
    near = base[:40] + 0.2 * rng.standard_normal((40, 16))
    x = np.concatenate([base, loose, tight, near, base[:20]])
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in zip(rng.permutation(len(x)), x, strict=True)]
    bad = [None, [0.0] * 16, [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0], []]
    return rows + [(10_000 + i, v) for i, v in enumerate(bad)]


def test_links_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")
    found = descent.near_duplicates(df)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.rows.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert found.recall >= 0.99
    links = sum(n for n, _, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.97 * links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] != want[i][1:] for i in want) <= 3


def test_empty_single_and_null_id(spark):
    kind = "vec_id long, embedding array<float>"
    assert descent.near_duplicates(spark.createDataFrame([], kind)).rows.count() == 0
    one = descent.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0]), (None, [1.0, 0.0])], kind)).rows.collect()
    assert sorted((tuple(r) for r in one), key=str) == [(5, 0, 5, True), (None, 0, None, False)]


def test_repeated_rows_count(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in descent.near_duplicates(df).rows.collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), threshold=1.5)
