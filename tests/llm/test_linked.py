"""Pairs that share marks against brute force, in one group and in blocks of it."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common


def jaccard(a, b):
    return len(a & b) / len(a | b)


def roots_of(sets, threshold):
    root = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= threshold - 1e-12:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    return root


def sample(n, seed):
    """Sets around shared cores, so that most have a common part without being similar."""
    rng, out = random.Random(seed), {}
    core = set(range(40))
    for i in range(n):
        base = core if i % 3 else set(range(1000 + 100 * (i % 7), 1030 + 100 * (i % 7)))
        own = {rng.randrange(5000, 9000) for _ in range(rng.choice([0, 1, 4, 8, 12, 30]))}
        out[i] = (base - set(rng.sample(sorted(base), rng.choice([0, 1, 3])))) | own
    return out


@pytest.mark.parametrize(("meet", "side", "weight"), [(1024, 64, 1 << 21), (16, 5, 200)])
def test_one_crowded_group_loses_no_pair(spark, monkeypatch, meet, side, weight):
    for name, value in (("MEET", meet), ("SIDE", side), ("WEIGHT", weight), ("AT_ONCE", 100)):
        monkeypatch.setattr(common, name, value)
    truth = sample(90, 7)
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in truth.items()], "node long, shingles array<long>").cache()
    sketches = sets.select("node", F.lit(b"12345678").alias("sketch"), F.size("shingles").cast("long").alias("size"))
    everything = lambda a, b: np.ones(len(a), bool)
    similar = lambda c, n, m: c >= 0.8 * (n + m - c) - 1e-9
    marked = sets.select(F.explode(F.array(F.lit(1).cast("long"), F.col("node") % 4 + 10)).alias("mark"), "node")
    found = common.linked(marked, sketches, lambda nodes: sets.join(nodes, "node", "left_semi"), everything, similar)
    got = {i: i for i in truth} | {r.node: r.component for r in found.collect()}
    assert got == roots_of(truth, 0.8)
    assert common.linked(marked.limit(0), sketches, lambda nodes: sets, everything, similar).count() == 0


@pytest.mark.parametrize("far", [False, True])
def test_ties_of_one_crowded_group_grow_with_its_nodes(spark, monkeypatch, far):
    for name, value in (("MEET", 16), ("SIDE", 5)):
        monkeypatch.setattr(common, name, value)
    asked, real = [], common.components
    monkeypatch.setattr(common, "components", lambda edges: asked.append(edges.distinct().count()) or real(edges))
    n = 240
    # the least node is far from all others, in its sketch or in its shingles, which are near each other
    rows = spark.range(n).select(
        F.col("id").alias("node"), F.when((F.col("id") == 0) & F.lit(far), F.lit(b"00000000")).otherwise(F.lit(b"12345678")).alias("sketch"),
        F.when(F.col("id") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array(*[F.lit(k).cast("long") for k in range(9)], F.col("id") + 100)).alias("shingles"))
    rows = rows.withColumn("size", F.size("shingles").cast("long")).cache()
    similar = lambda c, x, y: c >= 0.8 * (x + y - c) - 1e-9
    close = lambda a, b: (a == b).all(axis=1)
    marked = rows.select(F.explode(F.array(*[F.lit(m).cast("long") for m in range(6)])).alias("mark"), "node")
    found = common.linked(marked, rows.select("node", "sketch", "size"), lambda nodes: rows.select("node", "shingles").join(nodes, "node", "left_semi"), close, similar)
    assert {r.node: r.component for r in found.where("node > 0").collect()} == {i: 1 for i in range(1, n)}
    assert max(asked) <= 4 * n, asked


def test_rows_of_a_crowded_group_without_links_grow_with_its_nodes(spark, monkeypatch):
    """Candidates that have too little in common with all others together meet none of them, and the few links are found."""
    for name, value in (("SIDE", 16), ("WEIGHT", 500)):
        monkeypatch.setattr(common, name, value)
    dealt, real = [], common.in_groups
    monkeypatch.setattr(common, "in_groups", lambda df, work: dealt.append(df.count()) or real(df, work))
    n = 400
    truth = {i: {*range(6), *range(1000 + 20 * i, 1014 + 20 * i)} for i in range(n)}
    truth |= {n + i: truth[7 * i] - {0} for i in range(5)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in truth.items()], "node long, shingles array<long>").cache()
    similar = lambda c, x, y: c >= 0.8 * (x + y - c) - 1e-9
    sketches = rows.select("node", F.lit(b"12345678").alias("sketch"), F.size("shingles").cast("long").alias("size"))
    found = common.linked(rows.select(F.lit(1).cast("long").alias("mark"), "node"), sketches, lambda nodes: rows.join(nodes, "node", "left_semi"), lambda a, b: np.ones(len(a), bool), similar)
    assert {r.node: r.component for r in found.where("node != component").collect()} == {n + i: 7 * i for i in range(5)}
    assert max(dealt) <= 4 * n, dealt


def test_nodes_are_able_to_link_by_shingles_of_other_roots(spark):
    """Counts are the same however a group's shingles are dealt, and a root's own don't count."""
    rng = random.Random(4)
    sets = {i: sorted(rng.sample(range(60), rng.randint(1, 12))) for i in range(50)}
    root, group = {i: i % 9 // 2 for i in sets}, {i: i % 2 for i in sets}
    rows = spark.createDataFrame([(group[i], root[i], i, len(s), s) for i, s in sets.items()], "group long, root long, node long, size long, shingles array<long>")
    common_to = lambda i: sum(any(v in sets[j] for j in sets if group[j] == group[i] and root[j] != root[i]) for v in sets[i])
    similar = lambda c, x, y: c >= 0.8 * np.sqrt(x * y) - 1e-9
    want = {i for i in sets if similar(common_to(i), len(sets[i]), max(1, common_to(i)))}
    assert 0 < len(want) < len(sets)
    for weight in (10, 1 << 21):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "WEIGHT", weight)
            got = common.able(rows.drop("shingles"), rows.select("node", "shingles"), similar)
            assert {r.node for r in got.collect()} == want


def test_forest_is_components():
    rng = random.Random(3)
    for n in (1, 5, 40):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
        want = list(range(n))
        for a, b in edges:
            x, y = sorted((want[a], want[b]))
            want = [x if v == y else v for v in want]
        i, j = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert common.forest(n, i, j).tolist() == want


def test_forest_equals_union_find():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 400))
        i, j = rng.integers(0, n, (2, int(rng.integers(1, 2 * n))))
        root = list(range(n))

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
        assert common.forest(n, i, j).tolist() == [top(x) for x in range(n)], seed
