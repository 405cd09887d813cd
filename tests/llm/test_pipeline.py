"""The pipeline's stages, each against what its own input has, over the smallest tables and added rows."""

import random
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tidewater.llm import simhash, substring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into the first stage and that come out of each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    english = docs.where("lang = 'en' and length(text) > 600").orderBy("doc_id").first()
    words = english.text.split()
    passage = " ".join(rng.choice(words) for _ in range(80))
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    added = [
        (90001, english.text, "copy of a document"), (90002, f"{own(60)} {passage} {own(60)}", "passage"), (90003, f"{own(60)}\n{passage} {own(60)}", "passage"),
        (90004, None, "null"), (90005, "", "empty"), (90006, "12 34 !!", "no letters"), (None, own(90), "null id"), (90007, own(70), "one id"), (90007, own(75), "one id"),
    ]
    extra = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in added], docs.schema)
    now = docs.unionByName(extra).withColumns({"spans": F.lit(1), "lang_found": F.lit("x"), "digest_here": F.lit(2), "cleaned": F.lit("y")})
    out = [now]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "-"))
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        out.append(now)
    return out, passage, english.doc_id


def test_all_but_the_last_keep_the_columns(stages):
    out, _, _ = stages
    assert all(sorted(d.columns) == sorted(out[0].columns) for d in out[:-1])


def test_language(stages):
    out, _, _ = stages
    kept = {(r.doc_id, r.text): r.lang for r in out[1].collect()}
    assert not {90004, 90005, 90006} & {i for i, _ in kept}
    rows = {(r.doc_id, r.text): r.lang for r in out[0].where("lang is not null").collect()}
    same = [kept[k] == lang for k, lang in rows.items() if k in kept]
    assert sum(same) >= 0.98 * len(rows)


def test_near_dedup_equals_brute_force(stages):
    out, _, english = stages
    rows = sorted((r.doc_id, r.text) for r in out[1].where("doc_id is not null").distinct().collect())
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    root, by = list(range(len(rows))), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    near = {(a, b) for group in by.values() if len(group) < 100 for a in group for b in group if a < b}
    for a, b in near:
        if len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9:
            x, y = sorted((root[a], root[b]))
            root = [x if v == y else v for v in root]
    want = {rows[r][0] for r in set(root)}
    got = [r.doc_id for r in out[2].collect()]
    assert 90001 not in got and english in got
    assert {i for i in got if i is not None} == want and got.count(None) == 1 and got.count(90007) == 2


def test_repeats_go_once(stages):
    out, passage, _ = stages
    texts = {r.doc_id: r.text for r in out[3].collect()}
    assert passage in " ".join(texts[90002].split()) and passage not in " ".join(texts[90003].split())
    before = {(r.doc_id, r.text) for r in out[2].collect()}
    left = out[3].select("doc_id", "text").where("text is not null")
    assert substring.repeated_spans(left).count() <= 0.02 * len(before)
    changed = [k for k in ((r.doc_id, r.text) for r in out[3].collect()) if k not in before]
    spans = {r.doc_id for r in substring.repeated_spans(out[2]).collect()}
    assert {i for i, _ in changed} <= spans


def test_benchmark_and_tokens(spark, stages):
    out, _, _ = stages
    items = [" ".join(r.text.split()[:12]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 12]
    texts = [" ".join(r.text.split()) for r in out[4].collect()]
    assert not any(i in t for i in items for t in texts)
    import hashlib

    digests = sorted(r.decoded_sha256 for r in out[5].collect())
    assert digests == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in out[4].collect())


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
