"""One query for each text operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, descent, langid, repair, secrets, simhash, substring, suffix_lm, urls, vectors, warc
from .common import save
from .oracle import SQL as ORACLE_SQL  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, with_ids=False)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(save(chat.format_turns(turns), "formatted"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = descent.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.rows.withColumn("audited_recall", F.lit(found.recall))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def fold(of: str, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.crc32(F.col(of).cast("string")) % parts


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_lm.score(docs.where(fold("doc_id", 10) != 0), docs)
    return found.withColumn("held_out", fold("doc_id", 10) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 5) != 0))
    held = docs.select("doc_id", "text")
    found = langid.identify(held, model, with_spans=False)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.digests(turns.select("conv_id").distinct(), repair.repair(repair.damaged(turns)))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_urls": op3_urls,
    "op4_simhash": op4_simhash,
    "op5_embeddings": op5_embeddings,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_lm": op8_lm,
    "op9_substring": op9_substring,
    "op10_langid": op10_langid,
    "op11_secrets": op11_secrets,
    "op12_repair": op12_repair,
    "op13_vectors": op13_vectors,
}
