"""Conversations back to the shape (system?) (user assistant)+ by the cheapest edits, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, save

#: Turns that one fold holds; a longer conversation is folded in pieces and then over the pieces.
PIECE = 512
#: The cost of what can't be reached.
NEVER = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Neighbouring initials of roles that need no edit.
LEGAL = ("su", "ua", "au")
#: What a text has to have (anything but ASCII white space) and how it has to end.
INK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# States of a repaired sequence: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = [f"c{i}" for i in range(4)]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by the checksum of ``conv_id:turn``; nulls in role, text and that key are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """The turns with their places (seq, from 0) in their conversations: by turn, nulls first, then role and text.

    A range sort spreads a huge conversation over tasks; places add the counts of its earlier ranges.
    """
    dealt = save(turns.repartitionByRange("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.sum("n").over(earlier).alias("before"))
    before = save(counts.where("before is not null"), "offsets")
    placed = dealt.withColumn("row", F.row_number().over(inside) - 1).join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    rows = save(placed.select("conv_id", (F.col("row") + F.coalesce("before", F.lit(0))).cast("long").alias("seq"), "turn", "role", "text"), "turns")
    forget(dealt)
    return rows


def piece_of(seq: str = "seq") -> Column:
    return F.floor(F.col(seq) / PIECE).cast("long").alias("piece")


def same(conv: str, piece: str | None = None) -> Column:
    met = F.col("conv_id").eqNullSafe(F.col(conv))
    return met if piece is None else met & (F.col("piece") == F.col(piece))


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, turns array<struct<seq, role, text, initial, fault>>): sorted, at most ``PIECE`` turns; fault is their first one or null.

    A duplicate is a turn after the first of its role and text in the conversation, whatever piece that is in.
    """
    firsts = turns.groupBy("conv_id", "role", "text").agg(F.min("seq").alias("seq")).groupBy(F.col("conv_id").alias("_conv"), piece_of().alias("_piece")).agg(F.collect_list("seq").alias("firsts"))
    own = F.struct("seq", "role", "text", F.substring("role", 1, 1).alias("initial"))
    each = turns.groupBy("conv_id", piece_of()).agg(F.array_sort(F.collect_list(own)).alias("turns")).join(firsts, same("_conv", "_piece"), "left")
    fault = lambda t: (
        F.when(~t["text"].rlike(INK), "blank").when(~F.array_contains(F.coalesce("firsts", F.array().cast("array<bigint>")), t["seq"]), "duplicate").when(~t["text"].rlike(ENDED), "truncated")
    )
    return each.select("conv_id", "piece", F.transform("turns", lambda t: t.withField("fault", fault(t))).alias("turns"))


def path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def after(c: Column, cost: Column | int, letters: Column | str) -> Column:
    """A path with an edit more."""
    return path(c["cost"] + cost, F.concat(c["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def started(at: Column) -> Column:
    return F.struct(*[path(F.when(at == i, 0).otherwise(NEVER), F.lit("")).alias(c) for i, c in enumerate(STATES)])


def inserted(acc: Column) -> list[Column]:
    """The least paths to each state with what may be inserted before the next turn; more than two turns in a row never pay."""
    none, system, user, assistant = (acc[c] for c in STATES)
    asks = F.least(user, *[after(c, INSERT, "I") for c in (none, system, assistant)])
    says = F.least(assistant, after(user, INSERT, "I"), *[after(c, 2 * INSERT, "II") for c in (none, system)])
    return [none, system, asks, says]


def edited(acc: Column, turn: Column) -> Column:
    """The least paths to each state after one turn more: it is kept, given another role or deleted."""
    none, system, user, assistant = inserted(acc)
    must = F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    more = F.when(must, NEVER).when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    keep = lambda c, initial: after(c, more + F.when(turn["initial"] == initial, 0).otherwise(NEVER), "K")
    speak = lambda c, initial: after(c, more + F.when(turn["initial"] == initial, 0).otherwise(REROLE), F.when(turn["initial"] == initial, "K").otherwise("R"))
    gone = [after(c, DELETE, "D") for c in (none, system, user, assistant)]
    return F.struct(
        gone[EMPTY].alias("c0"), F.least(gone[SYSTEM], keep(none, "s")).alias("c1"),
        F.least(gone[USER], *[speak(c, "u") for c in (none, system, assistant)]).alias("c2"),
        F.least(gone[ASSISTANT], speak(user, "a")).alias("c3"),
    )


def folded(found: DataFrame) -> DataFrame:
    """The pieces with exits: for each state that a piece may begin in, the cheapest edits to each state that it may end in."""
    starts = F.when(F.col("piece") == 0, F.array(F.lit(EMPTY))).otherwise(F.array(*[F.lit(i) for i in range(4)]))
    return found.withColumn("exits", F.transform(starts, lambda s: F.aggregate("turns", started(s), edited)))


def illegal(initials: Column) -> Column:
    """Neighbours whose initials aren't a legal pair."""
    n = F.greatest(F.size(initials) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(initials, 1, n), F.slice(initials, 2, n), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long")


def chosen(cut: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, states): a conversation's faults, its cheapest edits and the state after each piece."""
    count = lambda kind: F.size(F.filter("turns", lambda t: t["fault"] == kind)).cast("long").alias(kind)
    initials = F.transform("turns", lambda t: t["initial"])
    told = cut.select("conv_id", "piece", "exits", count("blank"), count("duplicate"), count("truncated"), illegal(initials).alias("inside"), F.get(initials, F.lit(0)).alias("first"), F.element_at(initials, -1).alias("last"))
    whole = told.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "inside")],
        F.array_sort(F.collect_list(F.struct("piece", "first", "last", "exits"))).alias("pieces"),
    )
    n = F.size("pieces") - 1
    borders = F.zip_with(F.slice("pieces", 1, n), F.slice("pieces", 2, n), lambda a, b: F.concat(a["last"], b["first"]))
    long = lambda cost, audit, states: F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), states.alias("states"))
    begun = F.struct(*[long(F.lit(0 if i == EMPTY else NEVER), F.lit(""), F.lit("")).alias(c) for i, c in enumerate(STATES)])

    def over(acc: Column, p: Column) -> Column:
        def to(k: int) -> Column:
            way = lambda j: F.get(p["exits"], F.lit(j))[STATES[k]]
            each = [long(F.coalesce(acc[c]["cost"] + way(j)["cost"], F.lit(NEVER)), F.concat(acc[c]["audit"], F.coalesce(way(j)["audit"], F.lit(""))), F.concat(acc[c]["states"], F.lit(str(k)))) for j, c in enumerate(STATES)]
            return F.least(*each).alias(STATES[k])

        return F.struct(*[to(k) for k in range(4)])

    more = lambda c, letters: long(c["cost"] + INSERT * len(letters), F.concat(c["audit"], F.lit(letters)), c["states"])
    best = F.aggregate("pieces", begun, over, lambda acc: F.least(acc["c0"], acc["c3"], more(acc["c2"], "I"), more(acc["c1"], "II"), more(acc["c0"], "II")))
    found = whole.withColumns({"illegal": (F.col("inside") + F.size(F.filter(borders, lambda p: ~p.isin(*LEGAL)))).cast("long"), "best": best})
    return found.select("conv_id", "blank", "duplicate", "truncated", "illegal", "best.*")


def applied(turns: Column, letters: Column, state: Column) -> Column:
    """The repaired turns of one piece: its edits in order, from the state that it begins in."""
    own = "array<struct<role:string,text:string,edit:string>>"
    begun = F.struct(F.lit(0).alias("at"), state.cast("int").alias("state"), F.array().cast(own).alias("out"))

    def step(acc: Column, letter: Column) -> Column:
        turn = F.get(turns, acc["at"])
        kept = F.when(turn["initial"] == "s", SYSTEM).when(turn["initial"] == "u", USER).otherwise(ASSISTANT)
        state = F.when(letter == "D", acc["state"]).when(letter == "K", kept).when(acc["state"] == USER, ASSISTANT).otherwise(USER)
        role = F.when(letter == "K", turn["role"]).when(acc["state"] == USER, "assistant").otherwise("user")
        text = F.when(letter == "I", "").otherwise(turn["text"])
        made = F.array(F.struct(role.alias("role"), text.alias("text"), letter.alias("edit")))
        return F.struct((acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), state.alias("state"), F.when(letter == "D", acc["out"]).otherwise(F.concat(acc["out"], made)).alias("out"))

    return F.aggregate(letters, begun, step, lambda acc: acc["out"])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest edits of every conversation, and its repaired turns.

    The first frame is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) by conversation, the second
    (conv_id, piece, repaired array<struct<role, text, edit>>) by pieces of conversations of ``PIECE`` turns, those that were inserted included.
    Turns go by turn, nulls first, ties by role and text, so that repeated rows are neighbours. Roles count by their
    initials; roles that are kept stay as they are. Null roles and texts are one space, null conv_ids are a conversation
    of their own; an empty table gives empty frames. No task holds more than a piece of a long conversation, but for
    its edits, a letter each, of which one row holds all. Ids and turns are cast to long; other columns are dropped.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    rows = numbered(rows)
    spread = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    spread = save(spread, "gaps")
    cut = save(folded(pieces(rows)), "pieces")
    forget(rows)
    best = save(chosen(cut), "edits")
    faults = best.join(spread, same("_conv")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    steps = best.select(F.col("conv_id").alias("_conv"), F.length("states").alias("n"), F.concat(F.lit("0"), "states").alias("states"), "audit", F.posexplode(F.split("states", "")).alias("_piece", "until"))
    begin = F.substring("states", F.col("_piece") + 1, F.lit(1)).cast("int")
    steps = steps.select("_conv", F.col("_piece").cast("long").alias("_piece"), begin.alias("begin"), F.col("until").cast("int").alias("until"), (F.col("_piece") == F.col("n") - 1).alias("final"), F.when(F.col("_piece") == F.col("n") - 1, F.col("audit")).alias("audit"))
    way = F.get(F.col("exits"), F.col("begin"))
    own = F.element_at(F.array(*[way[c]["audit"] for c in STATES]), F.col("until") + 1)
    ends = F.when(F.col("final"), F.regexp_extract("audit", "I*$", 0)).otherwise("")  # a piece ends with an edit of a turn
    letters = F.filter(F.split(F.concat(own, ends), ""), lambda x: x != "")
    done = cut.join(steps, same("_conv", "_piece")).select("conv_id", "piece", applied(F.col("turns"), letters, F.col("begin")).alias("repaired"))
    return faults, done


def digests(conversations: DataFrame, repaired: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A row for each of the conversations (conv_id), whatever is left of it: its faults, edits and the digest of its repaired turns."""
    faults, turns = repaired
    line = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    some = turns.where(F.size("repaired") > 0).groupBy(F.col("conv_id").alias("_said")).agg(F.array_sort(F.collect_list(F.struct("piece", line.alias("lines")))).alias("parts"))
    digest = some.select("_said", F.sha2(F.array_join("parts.lines", "\n"), 256).alias("repaired_sha256"))
    told = faults.withColumnRenamed("conv_id", "_conv")
    found = conversations.join(told, same("_conv"), "left").join(digest, same("_said"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
