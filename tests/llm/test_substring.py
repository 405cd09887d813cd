"""Substring dedup against brute force: exact passages word by word, near copies of paragraphs by Jaccard similarity."""

import random

import numpy as np
import pytest

from tidewater.llm import substring

LEAST = 50


def brute(texts):
    """Runs of words of each text that have to go: passages of LEAST words or more that stand in a lesser text."""
    words = {i: t.split() for i, t in texts.items()}
    grams = {i: [tuple(w[k : k + substring.GRAM]) for k in range(len(w) - substring.GRAM + 1)] for i, w in words.items()}
    shared = {i: {j for j in texts if j != i and longest(words[i], words[j]) >= LEAST} for i in texts}
    hit = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for i in texts:
        near = set()
        for j in shared[i]:
            for a, b, n in common_runs(words[i], words[j]):
                if n >= LEAST:
                    near |= set(range(a, a + n - substring.GRAM + 1))
        for k in near:
            if any(grams[i][k] in grams[j] for j in shared[i] if j < i):
                hit[i][k : k + substring.GRAM] = True
    return {i: runs(h) for i, h in hit.items()}


def common_runs(a, b):
    before, out = {}, []
    for i, w in enumerate([*a, None]):
        now = {j: before.get(j - 1, 0) + 1 for j in range(len(b)) if w is not None and b[j] == w}
        out += [(i - n, j + 1 - n, n) for j, n in before.items() if j + 1 not in now]
        before = now
    return out


def lines(text):
    """(first word, words, shingles) of the lines that are paragraphs."""
    out, at = [], 0
    for line in text.split("\n"):
        w = line.split()
        if len(w) >= substring.LEAST_WORDS:
            out.append((at, len(w), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
        at += len(w)
    return out


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def longest(a, b):
    return max((n for _, _, n in common_runs(a, b)), default=0)


def runs(hit):
    edge = np.diff(np.r_[0, hit.astype(int), 0])
    return [(int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= LEAST]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (51, 50, 49, 55, 120, 30)]
    texts = {}
    for i in range(24):
        w = [word() for _ in range(rng.randrange(60))]
        for s in rng.sample(shared, rng.randrange(3)):
            lo = 0 if rng.random() < 0.8 else rng.randrange(len(s))
            w += s[lo:] + [word() for _ in range(rng.randrange(25))]
        texts[i] = "".join(x + ("\n" if rng.random() < 0.1 else " ") for x in w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {}
    for r in substring.repeated_spans(df).collect():
        got.setdefault(r.doc_id, []).append((r.at, r.n))
    for i, must in brute(texts).items():
        # all of each passage goes; shorter repeats go along where they adjoin it
        assert all(any(a <= at and at + n <= a + m for a, m in got.get(i, [])) for at, n in must)
        words = {j: t.split() for j, t in texts.items() if j <= i}
        lesser = {tuple(w[k : k + substring.GRAM]) for j, w in words.items() if j < i for k in range(len(w))}
        for a, m in got.get(i, []):
            if m < LEAST:  # nothing but lines that a lesser text has
                ends = {at for at, n, k in lines(texts[i]) for j in range(i) if any(alike(k, o) for _, _, o in lines(texts[j])) for at in range(at, at + n)}
                assert ends >= set(range(a, a + m))
                continue
            repeated = [k for k in range(a, a + m - substring.GRAM + 1) if tuple(words[i][k : k + substring.GRAM]) in lesser]
            assert {k + d for k in repeated for d in range(substring.GRAM)} == set(range(a, a + m)) and m >= LEAST


def test_similar_paragraphs_are_found(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], set()
    for i in range(0, 80, 2):
        base = [word() for _ in range(rng.randrange(55, 200))]
        # every 48th word differs, so no run of 50 words is equal; the similarity is about 0.8
        near = [word() if k % 48 == 20 else w for k, w in enumerate(base)]
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, near)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            want.add((i + 1, 3, len(near)))
        rows += [(k, "\n".join([f"{word()} {word()} {word()}", " ".join(words), word()])) for k, words in ((i, base), (i + 1, near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.at, r.n) for r in substring.repeated_spans(df).collect()}
    assert len(want) > 15 and got <= want and len(got) >= 0.97 * len(want)


def test_short_paragraphs_are_found(spark):
    """Paragraphs of 20 to 49 words, equal or nearly so, alone or between others; those of 19 words stay."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    fill = lambda: " ".join(word() for _ in range(9))
    rows, want = [], set()
    for k, n in enumerate([19, 20, 21, 30, 30, 48, 49] * 3):
        base = [word() for _ in range(n)]
        near = [word() if k >= 7 and j == n - 1 else w for j, w in enumerate(base)]
        alone = k >= 14
        rows += [(2 * k, " ".join(base) if alone else f"{fill()}\n{' '.join(base)}\n{fill()}"), (2 * k + 1, " ".join(near) if alone else f"{fill()}\n{' '.join(near)}")]
        sets = [{tuple(x[j : j + 5]) for j in range(n - 4)} for x in (base, near)]
        if n >= 20 and alike(*sets):
            want.add((2 * k + 1, 0 if alone else 9, n, 2 * k))
    spans = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {(r.doc_id, r.at, r.n, r.kept_doc_id) for r in spans.collect()}
    assert len(want) >= 15 and got <= want and len(got) >= len(want) - 1


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, None), (3, ""), (None, passage), (4, f"x {passage}"), (4, f"x {passage}"), (4, f"one two {passage} three"), (5, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as span_doc", "3 as span_text")
    spans = substring.repeated_spans(df)
    # the whole lines of document 4 are similar to document 1
    assert sorted((r.doc_id, r.at, r.n, r.kept_doc_id) for r in spans.collect()) == [(4, 0, 61, 1), (4, 0, 63, 1)]
    got = sorted((r.doc_id or 0, r.text or "") for r in substring.removed(df, spans).collect())
    assert got == [(0, passage), (1, passage), (2, ""), (3, ""), (4, ""), (4, ""), (4, ""), (5, " \n ")]
    assert substring.removed(df, spans).columns == df.columns
    assert substring.repeated_spans(df.limit(0)).count() == 0


def test_results_do_not_depend_on_batches():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(200))).encode() for _ in range(20)]
    cutter = substring.Cutter(9, 4, 5, LEAST)

    def of(some):
        hashes, text, _, first = cutter.texts(some)
        grams = substring.gram_hashes(hashes, substring.GRAM)
        place = np.flatnonzero(text[: len(grams)] == text[substring.GRAM - 1 :])
        at = place[substring.anchors(grams[place], text[place], cutter.window)]
        return [(at[text[at] == k] - first[k]).tolist() for k in range(len(some))]

    assert of(texts) == [of([t])[0] for t in texts]
