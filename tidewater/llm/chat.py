"""Chat formatting with prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What counts as a control string inside texts (fixed values): the start of our own marks and those of common templates.
CONTROL = r"\\|(?<=<)(?=\|)|(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    """A backslash goes before each backslash and into each control string."""
    return F.regexp_replace(text, CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per turn: (conv_id, seq, segment, start, loss_start, loss_end).

    segment is the turn in the template, start its place in the text of the whole
    conversation (code points), seq its number from 0.  For a turn of the role
    ``target`` loss_start and loss_end bound its text in the conversation: ``examples`` expands that row to
    the training example of the conversation's text up to loss_end and the end mark, in
    which only this reply is trainable.  Contexts are kept once and shared by
    the examples, so that rows and bytes grow with the turns and not with their square.

    Null roles and texts are empty, null conv_ids form a conversation of their own; ties
    in turn go by role and text; repeated rows are repeated turns.  Turns are ordered
    by a range sort, and places come from sums of its partitions, so a huge conversation spreads over tasks.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    lead = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    dealt = (
        rows.repartitionByRange("conv_id", "turn", "role", "text").withColumns({"chunk": F.spark_partition_id(), "lead": lead, "body": body})
        .withColumn("segment", F.concat("lead", "body", F.lit(END)))
        .select("conv_id", "chunk", "turn", "role", "text", "segment", F.length("segment").cast("long").alias("n"), F.length("lead").alias("lead_n"), F.length("body").alias("body_n"))
    )
    dealt = save(dealt, "turns")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({"seq": F.row_number().over(inside) - 1, "start": F.coalesce(F.sum("n").over(ahead), F.lit(0))})
    sums = dealt.groupBy("conv_id", "chunk").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.sum("turns").over(earlier).alias("_turns"), F.sum("chars").over(earlier).alias("_chars"))
    base = save(base.where("_turns is not null"), "offsets")
    placed = local.join(base, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), "left")
    start = (F.col("start") + F.coalesce("_chars", F.lit(0))).cast("long")
    loss = F.when(F.col("role") == target, start + F.col("lead_n"))
    return placed.select("conv_id", (F.col("seq") + F.coalesce("_turns", F.lit(0))).cast("long").alias("seq"), "segment", start.alias("start"), loss.alias("loss_start"), (loss + F.col("body_n")).alias("loss_end"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text, loss, n): what the template and the masks of the ``examples`` say, unescaped.

    The examples are expanded from the turns and joined back to the segment that each of them trains on.
    """
    mask = examples(formatted).select(F.col("conv_id").alias("_conv"), "target_seq", F.col("context_end").alias("_from"), F.col("loss_start").alias("_lo"), F.col("loss_end").alias("_hi"))
    masked = formatted.join(mask, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seq") == F.col("target_seq")), "left")
    mark = F.instr("segment", TEXT)
    role = F.substring("segment", F.lit(len(TURN) + 1), mark - 1 - len(TURN))
    at = mark + len(TEXT)
    text = F.substring("segment", at, F.length("segment") - len(END) - at + 1)
    lost = F.substring("segment", (F.col("_lo") - F.col("_from") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int"))
    return masked.select("conv_id", "seq", unescape(role).alias("role"), unescape(text).alias("text"), unescape(lost).alias("loss"), F.length("segment").cast("long").alias("n"))


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, target_seq, context_turns, context_end, loss_start, loss_end): an example for each target turn."""
    return formatted.where("loss_start is not null").select(
        "conv_id", F.col("seq").alias("target_seq"), F.col("seq").alias("context_turns"), F.col("start").alias("context_end"), "loss_start", "loss_end"
    )


def render(formatted: DataFrame) -> DataFrame:
    """(conv_id, target_seq, example, loss_start, loss_end): examples with their texts in full.

    Each example repeats all turns before its target; meant for trainers that read the
    examples of chosen conversations.
    """
    turns = formatted.select(F.col("conv_id").alias("_conv"), F.col("seq").alias("_seq"), "segment")
    joined = examples(formatted).join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_seq") <= F.col("target_seq")))
    parts = joined.groupBy("conv_id", "target_seq", "loss_start", "loss_end").agg(F.sort_array(F.collect_list(F.struct("_seq", "segment"))).alias("parts"))
    return parts.select("conv_id", "target_seq", F.array_join("parts.segment", "").alias("example"), "loss_start", "loss_end")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output."""
    turns = read_turns(formatted).select("conv_id", "n", F.struct("seq", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss").alias("t"), F.length("loss").alias("k"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("loss_chars"), F.sum("n").alias("formatted_chars"), F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("turns.turn", ""), 256).alias("turns_sha256"),
        "loss_chars", F.sha2(F.array_join("turns.loss", ""), 256).alias("loss_sha256"), "formatted_chars",
    )
