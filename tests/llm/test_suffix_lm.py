"""The suffix tree against a brute-force one: it grows with the texts and goes beyond two words."""

import math
import random
from collections import Counter

import pytest

from tidewater.llm import common
from tidewater.llm import suffix_lm as lm


def brute(train, docs, depth):
    """Scores of each text by dictionaries of contexts."""
    tokens = [[*t.split(), ""] for t in train]
    base = Counter(w for t in tokens for w in t)
    whole = sum(base.values()) + lm.ADDED * (len(base) + 1)
    after = {}
    for t in tokens:
        for i, w in enumerate(t):
            for d in range(1, min(depth, i) + 1):
                after.setdefault(tuple(t[i - d : i]), Counter())[w] += 1
    states = {c: {w: n for w, n in s.items() if n >= lm.LEAST_SYMBOL} for c, s in after.items() if sum(s.values()) >= lm.LEAST_CONTEXT}

    def prob(context, w, among):
        p, d = (base[w] + lm.ADDED) / whole, 1
        while d <= len(context) and context[-d:] in among:
            c = context[-d:]
            n, own = sum(after[c].values()), states[c]
            p = (max(0, own.get(w, 0) - lm.DISCOUNT) + (n - sum(own.values()) + lm.DISCOUNT * len(own) + lm.SMOOTHING) * p) / (n + lm.SMOOTHING)
            d += 1
        return p

    kept = set()
    for c, own in states.items():
        n = sum(after[c].values())
        if sum(k / n * math.log(k / n / prob(c[1:], w, states)) for w, k in own.items()) >= lm.DIVERGENCE and own:
            kept |= {c[i:] for i in range(len(c))}
    scores = [sum(math.log10(prob(tuple(t[max(0, i - depth) : i]), w, kept)) for i, w in enumerate(t)) for t in ([*d.split(), ""] for d in docs)]
    return scores, kept


@pytest.mark.parametrize("cached", [0, 200_000])
def test_tree_equals_brute_force(spark, monkeypatch, cached):
    monkeypatch.setattr(lm, "CACHED_WORDS", cached)
    monkeypatch.setattr(lm, "CACHED_RUNS", cached)
    rng = random.Random(3)
    train = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 40)):
            # what comes next depends on three words before it
            known = len(text) > 2 and rng.random() < 0.7
            text.append(f"w{(int(text[-3][1:]) + int(text[-2][1:]) + int(text[-1][1:]) if known else rng.randrange(4)) % 4}")
        train.append(" ".join(text))
    docs = [*train[:20], "w1 w2 new w3 w4 w5", "", "new"]
    make = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, kept = brute(train, docs, lm.DEPTH)
    assert max(map(len, kept)) > 2
    got = {r.doc_id: r.score for r in lm.score(make(train), make(docs)).collect()}
    assert [got[i] for i in range(len(docs))] == pytest.approx(want)


def test_a_context_stays_however_large_the_corpus(spark):
    """Twelve occurrences make a context among 300,000 tokens too, where a share of 1e-4 asked for 30."""
    filler = [" ".join(f"f{(i * 7919 + j * j) % 5000}" for j in range(300)) for i in range(1000)]
    rows = list(enumerate([*filler, *["alpha beta"] * 12]))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    r = lm.score(train, spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")).first()
    assert r.score > r.base_score + 2


def test_what_is_no_longer_read_is_deleted_and_each_part_has_its_own_keys(spark, monkeypatch):
    """Before the look-ups only the model's tables are left on the disks, and a part reads no other part's keys."""
    monkeypatch.setattr(lm, "CACHED_WORDS", 0)
    monkeypatch.setattr(lm, "CACHED_RUNS", 0)
    left, wide, real = [], [], common.save

    def save(df, name):
        if name in ("scored", "values"):
            left.append((name, {p.rsplit("/", 1)[1].split("-")[0] for _, p in common._tables if exists(p)}))
        out = real(df, name)
        if name == "scored":
            wide.extend(c for c in out.columns if c.startswith("keys"))
        return out

    def exists(path):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    monkeypatch.setattr(common, "_tables", [])
    monkeypatch.setattr(lm, "save", save)
    texts = spark.createDataFrame([(i, f"a b c d{i % 3}") for i in range(30)], "doc_id long, text string")
    lm.score(texts, texts).collect()
    assert left[-1] == ("scored", {"words", "values"})
    assert not any("sieve" in names or "joined" in names for _, names in left)
    assert len(wide) == lm.PARTS
