"""The pipeline's near-dedup against brute force, by length of text."""

import random

import numpy as np
import pytest

from tidewater.llm import simhash


def cosine(a, b):
    return len(a & b) / np.sqrt(len(a) * len(b))


@pytest.mark.parametrize(("least", "most"), [(6, 30), (60, 600)])
def test_pairs_at_the_threshold_are_found(spark, least, most):
    rng, texts = random.Random(5), []
    for i in range(150):
        n = rng.randint(least, most)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        # words are changed one by one as long as the similarity stays at 0.8 or above
        now, base = words, set(simhash.shingle_hashes(" ".join(words).encode(), 5).tolist())
        for _ in range(100):
            other = [*now]
            other[rng.choice([0, -1, rng.randrange(n)])] = f"x{rng.randrange(10**6)}"
            if cosine(base, set(simhash.shingle_hashes(" ".join(other).encode(), 5).tolist())) < 0.8 - 1e-12:
                break
            now = other
        texts += [words, now]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = np.mean([got[i] == i - 1 for i in range(1, len(texts), 2)])
    assert found >= 0.98
    assert all(got[i] == i for i in range(0, len(texts), 2))


def test_copies_with_one_id_and_null_ids(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (1, "something else of a few words"), (None, " ".join(words)), (2, " ".join(words)), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    assert simhash.similar_groups(df.limit(0)).count() == 0
