"""Labels of words against all paths, and what is said of whole texts against a plain reading of the same word scores."""

import itertools

import numpy as np
import pytest

from tidewater.llm import langid

TEXTS = {
    "en": ["the water is clear and the fish are near the reef", "we saw the coral and the sand below the boat", "the light is low and the sea is green"],
    "fr": ["l'eau est claire et les poissons sont près du récif", "nous avons vu le corail et le sable sous le bateau", "la lumière est faible et la mer est verte"],
    "de": ["das wasser ist klar und die fische sind nahe am riff", "wir sahen die korallen und den sand unter dem boot", "das licht ist schwach und das meer ist grün"],
}


def worth(rows, path, switch):
    return sum(float(rows[t][p]) for t, p in enumerate(path)) - switch * sum(a != b for a, b in itertools.pairwise(path))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    for switch in (0.0, 0.7, 5.0):
        rows = [rng.normal(size=(n, 3)).astype(np.float32) for n in (6, 0, 1, 5, 3, 6)] + [np.zeros((4, 3), np.float32)]
        for own, path in zip(rows, langid.viterbi(rows, switch), strict=True):
            assert len(path) == len(own)
            best = max((worth(own, p, switch) for p in itertools.product(range(3), repeat=len(own))), default=0)
            assert worth(own, path.tolist(), switch) == pytest.approx(best, abs=1e-4)
    assert langid.viterbi([], 1.0) == [] and len(langid.viterbi([np.zeros((0, 3), np.float32)], 1.0)[0]) == 0


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t * 3, lang) for i, (lang, t) in enumerate((lang, " ".join(own[k:] + own[:k])) for lang, own in TEXTS.items() for k in range(3))]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain(model, text, switch):
    """(language, score, spans) by a dynamic programme word by word."""
    numbers = model.look_up([text])[0]
    words = [(k, model.scores[n], int(model.sizes[n])) for k, n in enumerate(numbers.tolist()) if not np.isnan(model.scores[n]).any()]
    if not words:
        return "und", 0.0, []
    best = [(float(s), (j,)) for j, s in enumerate(words[0][1])]
    for _, scores, _ in words[1:]:
        best = [max(((w + float(scores[j]) - (switch if p[-1] != j else 0), (*p, j)) for w, p in best), key=lambda x: x[0]) for j in range(len(best))]
    path = max(best, key=lambda x: x[0])[1]
    share = [sum(n for (_, _, n), p in zip(words, path, strict=True) if p == j) for j in range(len(model.langs))]
    spans = []
    for (k, _, _), p in zip(words, path, strict=True):
        if spans and spans[-1][2] == model.langs[p]:
            spans[-1][1] = k + 1
        else:
            spans.append([k, k + 1, model.langs[p]])
    return model.langs[int(np.argmax(share))], max(share) / sum(share), spans


def test_texts_equal_a_plain_reading(spark, model):
    mixed = [" ".join(a + b) for a in TEXTS.values() for b in TEXTS.values()]
    texts = [*mixed, "the fish 123 !! le sable", "das", "a", "", None, " ", "12 34 ?!", "Ω ω", "水 the 水", "the\n\nfish\tles", "é" * 500, ("the sand " * 400 + "und die fische " * 300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "the fish", "x"), (0, "la mer", "x")], "doc_id long, text string, lang string")
    got = langid.identify(df, model).collect()
    want = [(i, *plain(model, t or "", langid.SWITCH)) for i, t in enumerate(texts)] + [(None, *plain(model, "the fish", langid.SWITCH)), (0, *plain(model, "la mer", langid.SWITCH))]
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    assert sorted(((r.doc_id, r.lang_pred, r.score, [[s.start, s.end, s.lang] for s in r.spans]) for r in got), key=key) == sorted([(i, lang, pytest.approx(s), spans) for i, lang, s, spans in want], key=lambda r: (str(r[0]), r[1], round(float(r[2].expected), 6)))
    assert {r.lang_pred for r in got} >= {"en", "fr", "de", "und"}


def test_no_language_and_no_rows(spark, model):
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the fish")], "doc_id long, text string")
    assert tuple(langid.identify(df, none).first())[1:3] == ("und", 0.0)
    assert langid.identify(df.limit(0), model).count() == 0
