"""Substring dedup: paragraphs that repeat across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, forget, fresh, linked, save, tidy, word_bounds, word_hashes

SEED = 42
#: Paragraphs of fewer words are compared as parts of longer passages only.
LEAST_WORDS = 20
#: Words of a gram, the unit of exact passages.
GRAM = 12


def bands_for(threshold: float, recall: float, most: int = 40) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs at the threshold with the recall."""
    for rows in range(8, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; run i begins at word i."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ hashes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of each run of ``width`` values."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def anchors(grams: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Places of grams that are the least of any ``window`` adjoining grams of one text (text: the number of each gram's text).

    The choice depends on the window's words alone, so two texts that share ``window`` grams share one of these.
    """
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = sliding(grams, window, True)
    low[text[: len(low)] != text[window - 1 :]] = 0
    around = np.r_[np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)]
    return np.flatnonzero((sliding(around, window, False) == grams) & (grams > 0))


class Cutter:
    """Cuts texts into paragraphs (lines) with MinHash signatures, and into anchors of passages."""

    def __init__(self, bands: int, rows: int, size: int, least_run: int) -> None:
        rng = np.random.default_rng(SEED)
        self.bands, self.rows, self.size = bands, rows, size
        self.window = max(1, least_run - GRAM + 1)
        self.odd = rng.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of some texts the hashes, texts and lines, and the number of each text's first word."""
        raw = b"\n".join(texts)
        start, end = word_bounds(raw)
        offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(offset, start, side="right") - 1
        line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), start)
        return word_hashes(raw, start, end), text, line, np.searchsorted(text, np.arange(len(texts)))

    def signatures(self, hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """MinHash values of the ``size``-word shingles of runs of words, a row for each run; all have ``size`` words or more."""
        if not len(at):
            return np.zeros((0, len(self.odd)), np.uint32)
        kept = n - self.size + 1
        first = np.cumsum(kept) - kept
        place = np.repeat(at - first, kept) + np.arange(int(kept.sum()))
        shingles = (gram_hashes(hashes, self.size)[place] >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(at), len(self.odd)), np.uint32)
        for i, (odd, add) in enumerate(zip(self.odd, self.add, strict=True)):
            mixed = shingles * odd + add
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(13)
            out[:, i] = np.minimum.reduceat(mixed, first)
        return out

    def keys(self, least: np.ndarray) -> np.ndarray:
        """A key for each band of the signatures."""
        out = np.zeros((len(least), self.bands), np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in range(self.rows):
            out = (out ^ least[:, row :: self.rows].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(32)
        return out


def close_signatures(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether MinHash signatures (a byte of each value) agree in 20 of 36 values: at a similarity of 0.8 all but one pair in 1,000 do."""
    return (a == b).mean(axis=1) >= 20 / 36


def run_hash(hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each run of n words that begins at word ``at``."""
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    some = hashes[np.repeat(at, n) + place]
    mixed = (some ^ (some >> np.uint64(32))) * (np.uint64(0x9E3779B97F4A7C15) * (2 * place + 1).astype(np.uint64))
    mixed ^= mixed >> np.uint64(29)
    return (np.add.reduceat(mixed, first) if len(at) else np.zeros(0, np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64)


def flat(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]), pa.array(rows.ravel()))


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, text): tk tells apart the texts of one id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").select("doc_id", F.hash("text").alias("tk"), "text")


def units(texts: DataFrame, cutter: Cutter) -> DataFrame:
    """(doc_id, tk, at, n, key, marks, sketch) of the paragraphs and, without marks, the anchors of all texts.

    at is the first word's number in the document, n the number of words, key the hash of the words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, text, line, first = cutter.texts(as_bytes(batch.column(2)))
            if not len(hashes):
                continue
            at = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            n = np.diff(np.r_[at, len(line)])
            at, n = at[n >= LEAST_WORDS], n[n >= LEAST_WORDS]
            least = cutter.signatures(hashes, at, n)
            grams = gram_hashes(hashes, GRAM)
            inside = text[: len(grams)] == text[GRAM - 1 :]
            place = np.flatnonzero(inside)
            place = place[anchors(grams[place], text[place], cutter.window)]
            for where, size, key, signed in ((at, n, run_hash(hashes, at, n), True), (place, np.full(len(place), GRAM), grams[place], False)):
                of = text[where]
                marks = flat(cutter.keys(least).view(np.int64)) if signed else pa.nulls(len(where), pa.list_(pa.int64()))
                sketch = pa.array([r.tobytes() for r in least.astype(np.uint8)], pa.binary()) if signed else pa.nulls(len(where), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array((where - first[of]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), marks, sketch],
                    names=["doc_id", "tk", "at", "n", "key", "marks", "sketch"],
                )

    return texts.mapInArrow(each, "doc_id long, tk int, at int, n int, key long, marks array<long>, sketch binary")


def paragraph_sets(texts: DataFrame, owners: DataFrame, cutter: Cutter) -> DataFrame:
    """(node, shingles array) of the paragraphs in ``owners`` (node, doc_id, tk, at, n)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _, _, first = cutter.texts(as_bytes(batch.column(0)))
            grams, nodes, made = gram_hashes(hashes, cutter.size).view(np.int64), [], []
            for base, some in zip(first.tolist(), batch.column(1).to_pylist(), strict=True):
                for p in some:
                    nodes.append(p["node"])
                    made.append(np.unique(grams[base + p["at"] : base + p["at"] + p["n"] - cutter.size + 1]))
            sets = pa.ListArray.from_arrays(np.cumsum([0, *map(len, made)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *made])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), sets], names=["node", "shingles"])

    by_text = owners.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("node", "at", "n")).alias("some"))
    return texts.join(by_text, ["doc_id", "tk"]).select("text", "some").mapInArrow(each, "node long, shingles array<long>").dropDuplicates(["node"])


def repeated_paragraphs(texts: DataFrame, found: DataFrame, cutter: Cutter, threshold: float) -> DataFrame:
    """(doc_id, tk, at, end, keep, class) of paragraphs that are similar to one of a lesser document."""
    whole = found.where("marks is not null")
    place = F.struct("doc_id", "tk", "at")
    owners = whole.groupBy("key").agg(F.min_by(F.struct("doc_id", "tk", "at", "n", "marks", "sketch"), place).alias("o"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    owners = save(owners.select(F.col("key").alias("node"), "lo", "hi", "o.*"), "owners")

    def sets(nodes: DataFrame) -> DataFrame:
        return paragraph_sets(texts, owners.join(nodes, "node", "left_semi"), cutter)

    def similar(common, n, m):  # noqa: ANN001, ANN202
        return common >= threshold * (n + m - common) - 1e-9

    marked = owners.select(F.explode("marks").alias("mark"), "node").distinct()
    classes = linked(marked, owners.select("node", "sketch", F.col("n").cast("long").alias("size")), sets, close_signatures, similar)
    named = owners.join(classes, "node", "left").select("node", "lo", "hi", F.coalesce("component", "node").alias("class"))
    by_class = named.groupBy("class").agg(F.min("lo").alias("keep"), F.max("hi").alias("last")).where("keep < last")
    repeated = save(named.join(by_class, "class").select(F.col("node").alias("key"), "keep", "class"), "repeated")
    hit = whole.select("doc_id", "tk", "at", "n", "key").join(repeated, "key").where("doc_id > keep")
    return hit.select("doc_id", "tk", "at", (F.col("at") + F.col("n")).alias("end"), "keep", "class")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, keep): keys of several documents, and the least of these."""
    return rows.groupBy("key").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last")).where("keep < last").select("key", "keep")


def repeated_passages(texts: DataFrame, found: DataFrame, cutter: Cutter) -> DataFrame:
    """(doc_id, tk, at, end, keep, class: null) of stretches of words whose grams all stand in a lesser document; deletes ``found``.

    Two documents that share a passage of ``least_run`` words share one of its anchors; all grams around shared
    anchors, up to a window's width away, are then compared.
    """
    marks = found.where("marks is null").select("doc_id", "tk", "at", "key")
    shared = save(shared_keys(marks).select("key"), "shared")
    wanted = marks.join(shared, "key", "left_semi").groupBy("doc_id", "tk").agg(F.collect_set("at").alias("ats"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, text, _, first = cutter.texts(as_bytes(batch.column(2)))
            grams = gram_hashes(hashes, GRAM)
            near = np.zeros(len(grams) + 1, np.int64)
            ends = np.r_[first[1:], len(hashes)] - GRAM + 1
            for base, end, ats in zip(first.tolist(), ends.tolist(), batch.column(3), strict=True):
                at = ats.values.to_numpy() + base
                np.add.at(near, np.maximum(at - cutter.window + 1, base), 1)
                np.add.at(near, np.minimum(at + cutter.window, end), -1)
            place = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            of = text[place]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array((place - first[of]).astype(np.int32)), pa.array(grams[place].view(np.int64))], names=["doc_id", "tk", "at", "key"]
            )

    asked = texts.join(wanted, ["doc_id", "tk"]).select("doc_id", "tk", "text", "ats")
    grams = save(asked.mapInArrow(each, "doc_id long, tk int, at int, key long"), "grams")
    forget(found)  # nothing reads the units any more
    again = save(shared_keys(grams), "again")
    hit = grams.join(again, "key").where("doc_id > keep")
    return hit.select("doc_id", "tk", "at", (F.col("at") + GRAM).alias("end"), "keep", F.lit(None).cast("long").alias("class"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, recall: float = 0.99, least_run: int = 50
) -> DataFrame:
    """Runs of words to remove: (doc_id, tk, at, n, kept_doc_id, component_id).

    Paragraphs are the lines of LEAST_WORDS words or more.  They
    collide by MinHash bands tuned for ``recall`` at the
    Jaccard ``threshold`` (``size``-word shingles), are verified exactly and
    clustered by components; the least doc_id of a
    cluster keeps its paragraphs, in any other document they count as repeated.  So does every word of a run of GRAM
    words that stands in a lesser document, where two documents share a passage of ``least_run`` words, whatever its lines.
    A run of adjoining repeated words is reported if it has ``least_run`` words or more; of shorter
    ones the similar paragraphs are, so that only lines of fewer than LEAST_WORDS words, and short passages inside other lines, stay.  kept_doc_id is the least document that keeps a part of the
    run, component_id the least cluster of similar paragraphs in it, null if it has none.  Null ids and texts are left out; a document is never compared with
    itself; repeated rows are reported once, several texts of one id each by its tk.  Texts are compared without regard to A-Z's case and white space.
    """
    if least_run < GRAM:
        raise ValueError(f"least_run has to be {GRAM} or more")
    arrow_rows(docs.sparkSession)
    with tidy() as keep:
        bands, rows = bands_for(threshold, recall)
        cutter = Cutter(bands, rows, size, least_run)
        texts = named_texts(docs, id_col, text_col)
        found = save(units(texts, cutter), "units")
        paragraphs = save(repeated_paragraphs(texts, found, cutter, threshold), "paragraphs")
        passages = save(repeated_passages(texts, found, cutter), "passages")
        return keep(save(runs_of(paragraphs.union(passages), least_run), "spans"))


def runs_of(hit: DataFrame, least_run: int) -> DataFrame:
    """Runs of adjoining or overlapping stretches of a text: those of ``least_run`` words or more, and of others what is similar paragraphs."""
    long = (F.col("upto") - F.col("from") >= least_run) | F.col("class").isNotNull()
    out = in_runs(in_runs(hit).where(long).drop("run", "from", "upto"))
    runs = out.groupBy("doc_id", "tk", "run").agg(F.min("at").alias("at"), (F.max("end") - F.min("at")).alias("n"), F.min("keep").alias("kept_doc_id"), F.min("class").alias("component_id"))
    return runs.select("doc_id", "tk", "at", "n", "kept_doc_id", "component_id")


def in_runs(hit: DataFrame) -> DataFrame:
    """The stretches with the number (run) and the words (from, upto) of the run that each is in."""
    w = Window.partitionBy("doc_id", "tk").orderBy("at", "end", "keep", "class")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hit.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("at")).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    one = Window.partitionBy("doc_id", "tk", "run")
    return runs.withColumns({"from": F.min("at").over(one), "upto": F.max("end").over(one)})


def removed(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of ``spans``; other columns and rows stay as they are.

    A removed run takes the white space before it along; where text stands on both sides,
    the longest of the two gaps' separators stays.
    """
    of, tk, some = (fresh(docs, n) for n in ("span_doc", "span_text", "spans"))
    per = spans.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias(some)).toDF(of, tk, some)

    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([cut_text(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.join(per, (docs[id_col].cast("long") == F.col(of)) & (F.hash(docs[text_col].cast("string")) == F.col(tk)), "left")
    made = F.when(F.col(some).isNull(), text).otherwise(cut(text, F.col(some))).alias(text_col)
    return joined.select(*[made if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def cut_text(text: str | None, spans) -> str | None:  # noqa: ANN001
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    start, end = word_bounds(raw)
    kept, last = [], 0
    for s in spans:
        at, n = int(s["at"]), int(s["n"])
        lo = end[at - 1] if at else 0
        hi = start[at + n] if at + n < len(start) else len(raw)
        gap = b"\n" if b"\n" in raw[lo : start[at]] or b"\n" in raw[end[at + n - 1] : hi] else b" "
        kept.append(raw[last:lo] + (gap if at and at + n < len(start) else b""))
        last = hi
    return (b"".join(kept) + raw[last:]).decode("utf-8", "surrogatepass")
