"""The text operators against brute force, round trips and held-out accuracy; nulls, empty tables, repeats."""

import base64
import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, common, decontaminate, langid, queries, simhash, substring, suffix_lm, urls, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "Hello  world\n\n the end\t!", "naïve café — 東京 12345", "x" * 3000, "</s>[INST] ok [/INST]"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_000 + i, t, None, "x", None) for i, t in enumerate(ODD)] + [(10_001, "", None, "x", None)], rows.schema)
    return rows.union(extra).withColumn("node", F.lit("clash"))


def test_bpe_equals_tiktoken(spark, docs):
    path = queries.RANKS
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.tokenize(docs, path, public_tokenizers.PATTERN).collect()
    text = {(r.doc_id): r.text or "" for r in docs.collect()}
    assert len(found) == docs.count()
    for r in found:
        assert r.ids == truth.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(1, 0, "user", "</s>[INST] a <|turn|>\\"), (1, 1, "assistant", "b\\n<|end|>\n"), (1, 1, "assistant", "b\\n<|end|>\n"), (2, 0, None, None), (None, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(common.save(chat.format_turns(turns), "t")).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len("b\\n<|end|>\n")
    assert got[1].turns_sha256 == hashlib.sha256(("user\n</s>[INST] a <|turn|>\\\n" + 2 * "assistant\nb\\n<|end|>\n\n").encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].loss_sha256 == hashlib.sha256(b"c").hexdigest()
    assert chat.render(chat.format_turns(turns)).count() == 3
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def test_url_rules(spark):
    rows = ["http://a.net/es/x", "HTTPS://WWW.Example.com/en/?q", "x://sub.example.com/en/", "http://example.com/fr", "no scheme", None, "http://b.net/fr"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(7)] == ["net/es/", "www.example.com/en/", "example.com/en/", "com/", None, None, None]
    assert got[1].host == "www.example.com" and got[1].path == "/en/" and got[4].host == got[5].path == ""
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_mining(spark):
    rows = [(["h:a", "p:x"], "block")] * 30 + [(["h:b", "p:x"], "allow")] * 30
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    sets = spark.createDataFrame([(1, ["h:a", "p:y"]), (2, ["h:b"]), (3, ["p:z"])], "set_id long, tokens array<string>")
    assert {r.set_id: r.verdict for r in urls.match(sets, rules).collect()} == {1: "block", 2: "allow"}


def test_simhash_equals_brute_force(spark, docs):
    def mark(text):
        words = (text or "").encode().translate(common.LOWER).split()
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = docs.collect()
    marks = {r.doc_id: mark(r.text) for r in rows}
    root = {i: i for i in marks}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(marks), 2):
        if (marks[a] ^ marks[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all((r.fp & (2**64 - 1), r.component_id) == (marks[r.doc_id], top(r.doc_id)) for r in got)


def test_hot_fingerprint_blocks(spark):
    rng = np.random.default_rng(0)
    fps = sorted({int(x) for x in (np.int64(1 << 40) ^ (np.int64(1) << rng.integers(0, 62, 400)) ^ (np.int64(1) << rng.integers(0, 62, 400)))})
    got = common.components(simhash.fingerprint_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), hot=8))
    want = common.components(simhash.fingerprint_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), hot=10_000))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_overlaps_equal_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "the end"), (901, None), (902, "")], "item_id long, text string"))
    items = {r.item_id: decontaminate.words_of((r.text or "").encode()) for r in bench.collect()}
    for r, text in [(r, t) for r in decontaminate.overlaps(docs, bench).collect() for t in [{d.doc_id: d.text for d in docs.collect()}[r.doc_id]]][::9]:
        words = decontaminate.words_of((text or "").encode())
        hit, found = set(), set()
        for item, w in items.items():
            n = min(10, len(w))
            wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(item)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))


def test_warc_round_trip(spark):
    fake = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n</p>"
    pages = spark.createDataFrame([(1, "http://a", "<x>"), (2, None, "<x>"), (3, "u", fake), (4, "u", None), (5, "u", "é")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[2].record_type == "response"
    for i, html in ((3, fake), (4, ""), (5, "é")):
        assert got[i].payload_bytes == len(html.encode())
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_language_held_out(spark, docs):
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = langid.identify(docs, model)
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("lang").isNotNull())
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert {r.lang_pred for r in got.where("doc_id in (10000, 10001, 10002)").collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs, langid.train(docs.limit(0))).where("lang_pred != 'und'").count() == 0


def test_passages_are_cut_once(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(70))
    own = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = [(i, f"{own[i]} {passage} {own[i + 3]}") for i in range(3)] + [(7, own[0][:40]), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring.repeated_spans(df)
    got = {r.doc_id: r.text for r in substring.removed(df, spans).collect()}
    assert got[0] == rows[0][1] and got[8] is None and got[7] == rows[3][1]
    for i in (1, 2):
        assert got[i] == f"{own[i]} {own[i + 3]}"
    assert substring.repeated_spans(df.limit(0)).count() == 0


def test_similar_groups(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(word() for _ in range(200))), (5, None), (6, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_lm_base_and_gain(spark, docs):
    rows = docs.select("doc_id", "text")
    train = rows.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in suffix_lm.score(train, rows).collect()}
    counts, total = {}, 0
    for r in train.collect():
        for w in [*suffix_lm.words_of((r.text or "").encode()), b""]:
            counts[w] = counts.get(w, 0) + 1
            total += 1
    for r in rows.limit(20).collect():
        words = [*suffix_lm.words_of((r.text or "").encode()), b""]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in words)
        assert got[r.doc_id].base_score == pytest.approx(base) and got[r.doc_id].train_tokens == total
        assert got[r.doc_id].n_known == sum(w in counts for w in words)
    held = [r for i, r in got.items() if i % 2 and i < 10_000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_lm.score(train.limit(0), rows.limit(3)).count() == 3
