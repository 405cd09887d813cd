"""Codes of vectors against a plain search, with ties, nulls, repeats, odd lengths and large numbers."""

import hashlib
import math

import numpy as np
import pytest

from tidewater.llm import vectors

KIND = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, parts=8, entries=16, rounds=6):
    """What the contract says, in Python's whole numbers."""
    kept = [(i, [math.floor(x * 4096) for x in v], l) for i, v, l, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        to = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), t in zip(kept, to, strict=True) if t[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], KIND).repartition(5)
    return sorted(map(tuple, vectors.compress(df).collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 0.001, 3e4])
def test_equals_plain_search(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=24) * scale).round(6).tolist(), None if i % 7 == 0 else i % 3) for i in range(150)]
    rows += [(3, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[9][1], 2)] + [(1000 + i, rows[9][1], 2) for i in range(40)]
    rows += [(-5, None, 1), (-4, [None] * 24, 1), (-3, [math.nan] * 24, 1), (-2, [math.inf] * 24, None)]
    assert found(spark, rows) == plain(rows)


def test_ties_go_to_the_lower_entry(spark):
    """Entries that are equal, or as far on either side."""
    rows = [(i, [float(i % 4)] * 8, 0) for i in range(30)] + [(100 + i, [i % 3 + 0.5] * 8, 1) for i in range(9)]
    assert found(spark, rows) == plain(rows)


def test_few_empty_and_odd_lengths(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1), (2, [1.0] * 7, 1), (3, [], 1)]) == []
    rows = [(2, [0.5, -0.25] * 4, 1), (3, [1.0] * 8, 1)]
    assert found(spark, [*rows, (9, [1.0] * 16, 1), (1, [1.0] * 7, 1)]) == plain(rows)


def test_search_by_tree_equals_all_entries():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 16):
        book = [tuple(map(int, e)) for e in rng.integers(-20, 20, (k, 3))]
        parts = rng.integers(-25, 25, (500, 3))
        code, square = vectors.Nearest(book).search(parts, 3)
        every = ((parts[:, None] - np.array(book)) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = vectors.fit(df)
    back = vectors.decode(vectors.encode(df, books), books).join(df, "vec_id").collect()
    assert len(back) == 500
    errors = {r.vec_id: r.error for r in vectors.encode(df, books).collect()}
    for r in back[:50]:
        ints = np.floor(np.array(r.embedding, float) * 4096)
        assert ((np.array(r.approximate) * 4096 - ints) ** 2).sum() == errors[r.vec_id]


def test_more_labels_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_LABELS", 1)
    rows = [(i, [float(i % 5)] * 8, None if i % 4 == 0 else i % 4) for i in range(60)]
    assert found(spark, rows) == plain(rows)
