"""Mined rules beside a brute-force search of all combinations of tokens."""

from itertools import combinations
from random import Random

from tidewater.llm import urls


def subsets(tokens):
    return [frozenset(c) for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)]


def token_set(host, path):
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in path.split("/") if x}


def test_verdicts_equal_brute_force(spark):
    rng = Random(5)
    rows = []
    for _ in range(600):
        host = rng.choice(["a", "b1", "c", "www.example"]) + "." + rng.choice(["com", "net", "org", "info"])
        path = "".join("/" + rng.choice(["es", "fr", "en", "shop", "v2", "blog"]) for _ in range(rng.randint(0, 3)))
        rows.append(f"https://{host}{path}/?q")
    support, confidence = 0.02, 0.6
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), min_support=support, min_confidence=confidence).collect()}
    assert len(got) == len(rows)
    sets = {i: token_set(r.host, r.path) for i, r in got.items()}
    labelled = [(sets[i], r.verdict) for i, r in got.items() if r.rule is not None]
    every = {s for t, _ in labelled for s in subsets(t)}
    rules = {}
    for s in every:
        said = [v for t, v in labelled if s <= t]
        for v in ("allow", "block"):
            n = said.count(v)
            if n >= support * len(labelled) and n >= confidence * len(said):
                rules[s, v] = n / len(said)
    decided = 0
    for i, r in got.items():
        if r.rule is None:
            fits = {v: c for (s, v), c in rules.items() if s <= sets[i] for c in [max(c for (s2, v2), c in rules.items() if v2 == v and s2 <= sets[i])]}
            best = {v for v, c in fits.items() if c == max(fits.values())} or {"allow"}
            assert r.verdict in best
            decided += bool(fits)
    assert decided > 50


def test_a_long_template_gives_one_item(spark):
    parts = "/".join(f"part{i}" for i in range(40))
    rows = [f"http://a.com/{parts}/{i}" for i in range(50)] + [f"http://b.net/es/{i}" for i in range(50)] + ["http://c.org/part3", "http://c.org/es"]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), min_support=0.1).collect()}
    assert got[100] == "allow" and got[101] == "block"


def test_no_labels_and_no_tokens_fall_to_the_default(spark):
    rows = [(1, "http://x.org/a"), (2, None), (2, None), (3, "://"), (4, "http://..//")]
    got = sorted((r.page_id, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), default="block").collect())
    assert got == [(1, "block"), (2, "block"), (2, "block"), (3, "block"), (4, "block")]
