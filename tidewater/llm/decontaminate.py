"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, fresh

#: Windows of so many consecutive words of an item.
WINDOW = 10
#: A benchmark is a stated test set; more text than this is refused rather than shipped to every task.
MOST_BENCHMARK_BYTES = 256 << 20

#: Bytes that belong to words: digits, a-z and all of multi-byte characters; A-Z are lower-cased, the others separate.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton over the word sequences of items.

    State 0 is the root; ``go`` holds transitions by word, ``link`` suffix links and
    ``size`` the longest string of each state.  ``items`` holds the items that a
    state's strings occur in, for states that can hold a window.  ``short`` maps a
    state to the items of fewer words than a window that end there as a whole.
    """

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.items: dict[int, frozenset] = {}
        self.short: dict[int, tuple[int, frozenset]] = {}

    def _extend(self, last: int, word: bytes) -> int:
        go, link, size = self.go, self.link, self.size
        if word in go[last]:  # an earlier item has this string already
            q = go[last][word]
            return q if size[q] == size[last] + 1 else self._split(last, word, q)
        new = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and word not in go[p]:
            go[p][word] = new
            p = link[p]
        if p != -1:
            q = go[p][word]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        go, link, size = self.go, self.link, self.size
        twin = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = twin
        while p != -1 and go[p].get(word) == q:
            go[p][word] = twin
            p = link[p]
        return twin

    def build(self, items: list[tuple[object, list[bytes]]]) -> Automaton:
        for _, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
        owners: dict[int, set] = {}
        ends: dict[int, set] = {}
        for item, words in items:
            state = 0
            for word in words:
                state = self.go[state][word]
                at = state
                while at > 0 and self.size[at] >= self.window and item not in owners.setdefault(at, set()):
                    owners[at].add(item)
                    at = self.link[at]
            if 0 < len(words) < self.window:
                at = state
                while self.size[self.link[at]] >= len(words):
                    at = self.link[at]
                ends.setdefault(at, set()).add((len(words), item))
        self.items = {k: frozenset(v) for k, v in owners.items()}
        # what of the short items ends at a state or at one of its suffixes
        order = sorted(range(1, len(self.go)), key=self.size.__getitem__)
        none: tuple[int, frozenset] = (0, frozenset())
        for s in order:
            n, found = self.short.get(self.link[s], none)
            own = ends.get(s, ())
            if own or found:
                self.short[s] = (max([n, *(k for k, _ in own)]), found | {i for _, i in own})
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(hit spans as [start, end) word numbers, merged and in order; items whose windows occur)."""
        go, link, size, window, short = self.go, self.link, self.size, self.window, self.short
        root = go[0]
        state, n, spans, items = 0, 0, [], set()
        for i, word in enumerate(words):
            step = go[state].get(word) if state else root.get(word)
            if step is None:
                if not state:
                    continue
                while state and word not in go[state]:
                    state = link[state]
                n = size[state]
                step = go[state].get(word)
                if step is None:
                    n = 0
                    continue
            state, n = step, n + 1
            if n >= window or state in short:
                back = 0
                at = state
                while size[link[at]] >= n:  # the state of the matched string itself
                    at = link[at]
                if n >= window:
                    back = n
                    while size[link[at]] >= window:
                        at = link[at]
                    items |= self.items.get(at, frozenset())
                # short items that end here: suffixes of what is matched
                k, found = self._short(state, n)
                items |= found
                back = max(back, k)
                if back:
                    lo = i + 1 - back
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, i + 1))
        return spans, items

    def _short(self, state: int, n: int) -> tuple[int, frozenset]:
        """Length of the longest short item, and all short items, that end at a match of n words."""
        while state and self.size[self.link[state]] >= n:
            state = self.link[state]
        whole = self.short.get(state)
        if whole is None:
            return 0, frozenset()
        if whole[0] <= n:
            return whole
        return self.short.get(self.link[state], (0, frozenset()))


def read_items(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int) -> list[tuple[object, list[bytes]]]:
    """Item ids with their words; the size is checked before anything is fetched."""
    some = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:
        raise ValueError(f"the benchmark has {total} bytes of text; at most {most_bytes} go to the tasks")
    return [(r.item_id, w) for r in some.toLocalIterator() if (w := words_of(r.text.encode()))]


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, most_bytes: int = MOST_BENCHMARK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of ``docs``.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an
    item, or of a whole item of fewer words.  spans holds the hit runs as [start,
    end) word numbers.  Null and empty texts have no words; repeated rows are
    returned as often as given, null ids with the rest; other columns are dropped.  Items with a null id or text
    or without words take no part; an empty benchmark hits nothing.  The automaton of the
    benchmark goes to every task, so its text is limited to ``most_bytes`` (an error beyond).
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shipped = spark.sparkContext.broadcast(Automaton(window).build(read_items(benchmark, item_col, item_text, most_bytes)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shipped.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                spans, items = automaton.scan(words)
                hit = sum(b - a for a, b in spans)
                listed = ",".join(sorted(map(str, items)))
                for col, v in zip(cols, (len(words), hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), hit > 0, [{"start": a, "end": b} for a, b in spans]), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>")


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and what stands between them."""
    inside = np.frombuffer(raw.translate(WORDS), np.uint8) != 32
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : start[a]])
        last = int(end[b - 1])
    return b"".join(out) + raw[last:]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, most_hit: float = 0.5, most_bytes: int = MOST_BENCHMARK_BYTES,
) -> DataFrame:
    """``docs`` without test items: hit spans are cut out of the texts, and documents of
    which more than ``most_hit`` of the words are hit are removed.

    All columns stay; rows without a hit stay as they are, those with null texts too.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shipped = spark.sparkContext.broadcast(Automaton(window).build(read_items(benchmark, item_col, item_text, most_bytes)))

    def clean(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        automaton, out = shipped.value, []
        for text in texts:
            if text is None:
                out.append((False, None))
                continue
            raw = text.encode("utf-8", "surrogatepass")
            words = words_of(raw)
            spans, _ = automaton.scan(words)
            drop = sum(b - a for a, b in spans) > most_hit * len(words)
            out.append((drop, text if not spans else None if drop else cut_words(raw, spans).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["drop", "text"])

    cleaned = F.pandas_udf(clean, "drop boolean, text string")
    name = fresh(docs, "cleaned")
    made = docs.withColumn(name, cleaned(F.col(text_col).cast("string")))
    return made.where(~F.col(name)["drop"]).withColumn(text_col, F.col(name)["text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
