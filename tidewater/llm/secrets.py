"""Secrets in texts: a trigram index narrows the rules that a text is checked with, regular expressions verify."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, save

#: Strings, or clauses of a query, that a rule is expanded to at most; beyond it the rule asks for less.
MOST = 64
#: Documents of one shard of the index, by calculation; bounds what a task holds of the postings.
SHARD = 1 << 16
#: Bytes of text whose trigrams are looked up at once.
SLICE = 1 << 20
#: Postings that a task gathers before it emits them.
GATHERED = 1 << 20
#: Candidates that are sent to every task; more are joined by a shuffle.
SENT = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts if ``group`` of it has ``least`` bytes; others are passed over with all that they matched."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern[bytes]:
        return re.compile(self.pattern.encode("ascii"), re.IGNORECASE if self.any_case else 0)


# The published shapes of common credentials.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
ADDED = [
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,255}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,250}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,250}"),
    Rule("login", r"(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%+-]{1,250}:[A-Za-z0-9._%+-]{1,250}@"),
]

Query = frozenset  # of clauses, any of which must hold; a clause is a frozenset of trigrams, all of which must occur
ANYTHING: Query = frozenset({frozenset()})


def slimmed(clauses: set[frozenset]) -> Query:
    """Without clauses that another one follows from."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def both(a: Query, b: Query) -> Query:
    made = slimmed({x | y for x in a for y in b})
    return made if len(made) <= MOST else min(a, b, key=len)


def grams_of(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def letters(items: list) -> set[str] | None:
    """The lower-cased characters of a class, or None if they are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def strings(kind: object, value: object) -> set[str] | None:
    """All that one item of a pattern can match, lower-cased, if that is a short list."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        return letters(value)
    if kind is op.SUBPATTERN:
        return joined(value[3])
    if kind is op.BRANCH:
        each = [joined(b) for b in value[1]]
        made = None if None in each else set().union(*each)
        return made if made is not None and len(made) <= MOST else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] is not op.MAXREPEAT and value[1] <= 3:
        one = joined(value[2])
        made = {""} if one is not None else None
        out = set(made or ()) if value[0] == 0 else set()
        for i in range(1, value[1] + 1):
            if made is None or len(made) * len(one) > MOST:
                return None
            made = {a + b for a in made for b in one}
            out |= made if i >= value[0] else set()
        return out if made is not None and len(out) <= MOST else None
    return {""} if kind is op.AT else None


def joined(items: Iterator) -> set[str] | None:
    out = {""}
    for kind, value in items:
        one = strings(kind, value)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def needs(kind: object, value: object) -> Query:
    """What an item that has no short list of strings asks for."""
    if kind is op.SUBPATTERN:
        return asked(value[3])
    if kind is op.BRANCH:
        made = slimmed(set().union(*[asked(b) for b in value[1]]))
        return made if len(made) <= MOST else ANYTHING
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
        return asked(value[2])
    return ANYTHING


def asked(items: Iterator) -> Query:
    """The trigrams that every match of a sequence has: runs of known strings, with what unknown items ask for between them."""
    query, run = ANYTHING, {""}
    for kind, value in items:
        one = strings(kind, value)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        query = both(query, slimmed({grams_of(r) for r in run}))
        query, run = (both(query, needs(kind, value)), {""}) if one is None else (query, one)
    return both(query, slimmed({grams_of(r) for r in run}))


def query_of(pattern: str) -> Query:
    """The Boolean query of lower-cased trigrams that follows from a pattern; ``ANYTHING`` if none must occur.

    Letters count in lower case in the index, whatever case a rule asks for.
    """
    return asked(parser.parse(pattern))


def postings(docs: DataFrame, grams: list[str], shards: int) -> DataFrame:
    """(shard, gram, ids array<long>) of docs (doc_id, text): which documents have which of the trigrams, by shards of the ids.

    Several rows may tell of a shard's trigram; an id is in one of them at least, and once in each.
    """
    kind = np.uint8 if len(grams) < 255 else np.uint16
    codes = np.array([int.from_bytes(g.encode("latin-1"), "big") for g in grams])

    def found(raw: bytes, table: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(grams) + 1, bool)
        for at in range(0, max(len(raw) - 2, 0), SLICE):
            byte = np.frombuffer(raw[at : at + SLICE + 2].translate(LOWER), np.uint8).astype(np.uint32)
            seen[table[byte[:-2] << 16 | byte[1:-1] << 8 | byte[2:]]] = True
        return np.flatnonzero(seen[1:])

    def rows(ids: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        shard = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)
        order = np.lexsort((ids, which, shard))
        ids, which, shard = ids[order], which[order], shard[order]
        new = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])])
        ids, which, shard = ids[new], which[new], shard[new]
        first = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (which[1:] != which[:-1])])
        lists = pa.ListArray.from_arrays(np.r_[first, len(ids)].astype(np.int32), pa.array(ids))
        return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array(which[first].astype(np.int32)), lists], names=["shard", "gram", "ids"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, kind)
        table[codes] = np.arange(1, len(codes) + 1)
        ids, which, n = [], [], 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            for i, raw in enumerate(as_bytes(batch.column(1))):
                some = found(raw, table)
                which.append(some)
                ids.append(np.full(len(some), own[i]))
                n += len(some)
            if n >= GATHERED:
                yield rows(np.concatenate(ids), np.concatenate(which))
                ids, which, n = [], [], 0
        if n:
            yield rows(np.concatenate(ids), np.concatenate(which))

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(each, "shard int, gram int, ids array<long>")


def candidates(index: DataFrame, queries: list[Query], grams: list[str]) -> DataFrame:
    """(doc_id, rules long): bit r tells that the document's trigrams fulfil query r; postings of a shard are intersected and united."""
    number = {g: i for i, g in enumerate(grams)}

    def fulfil(lists: dict[int, np.ndarray], query: Query) -> np.ndarray:
        none, out = np.zeros(0, np.int64), []
        for clause in query:
            own = sorted((lists.get(number[g], none) for g in clause), key=len)
            met = own[0]
            for other in own[1:]:
                met = np.intersect1d(met, other, assume_unique=True)
            out.append(met)
        return np.unique(np.concatenate(out))

    def each(table: pa.Table) -> pa.Table:
        gram, held = table["gram"].to_numpy(), table["ids"].combine_chunks()
        flat, which = held.values.to_numpy(), np.repeat(gram, np.diff(held.offsets.to_numpy()))
        lists = {g: np.unique(flat[which == g]) for g in np.unique(gram)}
        ids, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, query in enumerate(queries):
            if query != ANYTHING:
                ids.append(fulfil(lists, query))
                bits.append(np.full(len(ids[-1]), 1 << r))
        every, at = np.unique(np.concatenate(ids), return_inverse=True)
        mask = np.zeros(len(every), np.int64)
        np.bitwise_or.at(mask, at, np.concatenate(bits))
        return pa.table({"doc_id": every, "rules": mask})

    return index.groupBy("shard").applyInArrow(each, "doc_id long, rules long")


def spans_of(raw: bytes, rules: list[tuple[str, re.Pattern[bytes], int, int]], asks: int) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of the matches of the rules whose bits are set, in order."""
    out = []
    for r, (_, pattern, group, least) in enumerate(rules):
        if asks >> r & 1:
            out += [(m.start(), r, m.end()) for m in pattern.finditer(raw) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def find(docs: DataFrame, rules: list[Rule] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text", mask: str | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>[, redacted]) of every row of ``docs``, in whole texts.

    Matches of a rule are leftmost and don't overlap; those of different rules may. Spans go by
    start and then by the order of the rules; offsets are code points, ends exclusive.  A trigram index of the texts tells which
    rules a text has to be checked with; rules without a mandatory trigram check all.  With ``mask`` a
    column of the text is added in which that string replaces every span, joined where they overlap.  Null texts are empty;
    null ids are checked with all rules; repeated rows and ids are rows of their own; an
    empty table gives no rows.  Ids are cast to long; other columns are dropped.
    """
    if len(rules) > 62:
        raise ValueError("62 rules at most")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    queries = [query_of(r.pattern) for r in rules]
    always = sum(1 << r for r, q in enumerate(queries) if q == ANYTHING)
    grams = sorted({g for q in queries for clause in q for g in clause})
    if grams:
        index = save(postings(rows, grams, rows.count() // SHARD + 1), "postings")
        met = save(candidates(index, queries, grams), "candidates").withColumnRenamed("doc_id", "_id")
        told = F.broadcast(met) if met.count() <= SENT else met
        rows = rows.join(told, F.col("doc_id") == F.col("_id"), "left")
        asks = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(always)))
    else:
        asks = F.lit(always)
    rows = rows.select("doc_id", "text", asks.cast("long").alias("asks"))
    plain = [(r.kind, r.pattern, r.group, r.least, r.any_case) for r in rules]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(kind, Rule(kind, pattern, group, least, any_case).compiled(), group, least) for kind, pattern, group, least, any_case in plain]
        kinds = pa.array([r[0] for r in ready], pa.string())
        for batch in batches:
            start, end, which, n, out = [], [], [], [], []
            for raw, asks in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                raw = raw or b""
                found = spans_of(raw, ready, asks)
                n.append(len(found))
                if found and not raw.isascii():
                    code = np.r_[0, np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)]
                    start += code[[s for s, _, _ in found]].tolist()
                    end += code[[e for _, _, e in found]].tolist()
                else:
                    start += [s for s, _, _ in found]
                    end += [e for _, _, e in found]
                which += [r for _, r, _ in found]
                if mask is not None:
                    out.append(replaced(raw, found, mask.encode()))
            spans = pa.StructArray.from_arrays([kinds.take(pa.array(which, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["kind", "start", "end"])
            cols, names = [batch.column(0), pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), spans)], ["doc_id", "spans"]
            if mask is not None:
                cols, names = [*cols, pa.array(out, pa.binary()).cast(pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(each, "doc_id long, spans array<struct<kind: string, start: int, end: int>>" + ", redacted string" * (mask is not None))


def replaced(raw: bytes, found: list[tuple[int, int, int]], mask: bytes) -> bytes:
    """The text with each span, or spans that overlap together, as ``mask``."""
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [raw[at:s], mask]
        at = max(at, e)
    return b"".join([*out, raw[at:]])
