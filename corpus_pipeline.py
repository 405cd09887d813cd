"""From raw documents to token ids: the stages that prepare a training corpus.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes and rereads what each returns.  What a stage returns has to be written before
another stage is called, for that begins by deleting the scratch tables of the one before it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, langid, simhash, substring
from tidewater.llm.common import Scratch, delete, drop, fresh, owned, scratch_path

#: The part of a document's letters that its language has to hold.
LEAST_SCORE = 0.5

_made: Scratch = []


def alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the tables of the one before it deleted first and its own remembered."""

    @functools.wraps(stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(_made)
        with owned(_made):
            return stage(spark, docs, sf_dir)

    return wrapped


@alone
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters, most of them of one language; lang is what is found."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    lang, score = fresh(docs, "lang_found"), fresh(docs, "lang_score")
    found = langid.identify(docs, model, added=(lang, score))
    kept = found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(lang)).select(*[F.col(f"`{c}`") for c in docs.columns])


@alone
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of similar texts (see ``simhash.keep_one`` for null and repeated ids)."""
    return simhash.keep_one(docs)


@alone
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; what is left empty goes."""
    cut = substring.removed(docs, substring.repeated_spans(docs))
    return cut.withColumn("n_chars", F.length("text").cast("long")).where(F.length(F.trim("text")) > 0)


@alone
def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that mostly are such passages go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = decontaminate.decontaminate(docs, items)
    return cut.withColumn("n_chars", F.length("text").cast("long")).where(F.length(F.trim("text")) > 0)


@alone
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and of the bytes they decode to."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmarks),
    ("byte-level BPE", encode),
]

#: SQL can't express the language model, the verified bands and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"), lasting=True)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
