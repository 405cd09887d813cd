"""Empty tables, nulls, repeated rows and ids, long texts and clashing columns of the earlier operators."""

import hashlib
import math

import public_tokenizers
import pytest

from tidewater.llm import bpe, chat, decontaminate, queries, simhash, substring, suffix_lm, warc

DOCS = "doc_id long, text string, lang string, n_tokens long"


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b", "x", 1), (None, None, None, None), (1, "a b", "x", 1)], DOCS)
    assert bpe.tokenize(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert decontaminate.overlaps(none, items).count() == 0
    got = decontaminate.overlaps(some, items).collect()
    assert [(r.n_hit, r.n_items, r.contaminated, r.spans) for r in got] == [(0, 0, False, [])] * 3
    assert sorted(r.n_words for r in got) == [0, 2, 2]
    assert sorted(map(str, decontaminate.decontaminate(some, items).collect())) == sorted(map(str, some.collect()))
    assert suffix_lm.score(some.where("doc_id = 1"), none).count() == 0


def test_ids_decode_to_the_texts(spark):
    texts = ["", "naïve café — 東京 12345", "x" * 3000, "a b\t\r\n  c", "</s>[INST] ok [/INST]", "😀" * 700, None]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0)], DOCS)
    made = bpe.tokenize(docs, queries.RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(made, queries.RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "no id"}
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(nulls, queries.RANKS).collect()} == {1: None, 2: b""}


def test_examples_hold_their_whole_context(spark):
    turns = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "hi\\"), (1, 2, "assistant", "one\n"), (1, 3, "user", "[INST]"), (1, 4, "assistant", "two</s>"), (2, 0, "assistant", ""), (3, 0, "user", "alone")]
    formatted = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    segments = {(r.conv_id, r.seq): r.segment for r in formatted.collect()}
    got = {(r.conv_id, r.target_seq): r for r in chat.render(formatted).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 0)}
    for (conv, seq), r in got.items():
        assert r.example == "".join(segments[conv, k] for k in range(seq + 1))
        said = spark.createDataFrame([(r.example[r.loss_start : r.loss_end],)], "t string").select(chat.unescape(chat.F.col("t"))).first()[0]
        assert said == next(t for c, k, _, t in turns if (c, k) == (conv, seq))


def test_repeated_pages(spark):
    rows = [(1, "u", "<x>"), (3, "u", "<x>"), (3, "u", "<x>"), (2, None, None), (4, "u", "")]
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")).collect())
    assert got == [(1, "revisit", 3, 3), (2, "revisit", 4, 0), (3, "response", None, 3), (3, "response", None, 3), (4, "response", None, 0)]


def test_scores_of_odd_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    train = spark.createDataFrame([(i, "the sea is blue . the sea is deep .", "x", 0) for i in range(30)] + [(99, None, None, 0), (100, long, "x", 0)], DOCS)
    docs = spark.createDataFrame([(1, "The sea IS blue", "x", 0), (1, "The sea IS blue", "x", 0), (None, "the sea is blue", "x", 0), (2, None, "x", 0), (3, "", "x", 0), (4, long, "x", 0), (5, "\x00   é", "x", 0)], DOCS)
    got = suffix_lm.score(train, docs).collect()
    assert len(got) == 7
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert by[1, 5].score == pytest.approx(by[None, 5].score) and by[1, 5].score > by[1, 5].base_score
    assert by[2, 1].score == by[3, 1].score and by[4, 30_001].n_known == 30_001 and by[5, 4].n_known == 1
    total, distinct = 30 * 11 + 1 + 30_001, 6 + 1 + 97
    assert by[1, 5].train_tokens == total
    p = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    assert by[1, 5].base_score == pytest.approx(p(60) + p(60) + p(60) + p(30) + p(32))


def test_spans_of_repeated_rows_and_long_lines(spark):
    line = " ".join(f"v{i}" for i in range(5000))
    rows = [(1, line, "x", 0), (2, f"q {line}", "x", 0), (2, f"q {line}", "x", 0), (None, line, "x", 0)]
    spans = substring.repeated_spans(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as tk", "2 as at"))
    assert [(r.doc_id, r.n) for r in spans.collect()] in ([(2, 5001)], [(2, 5000)])
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
