"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_rows, as_bytes, components, fresh, linked, save, tidy

SEED = 42
#: Rows of hashes whose bits are counted at once; bounds memory for very long texts.
CHUNK = 65536
#: Distinct shingles below which a text has too few partitions to be found by its blocks alone.
SHORT = 100


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included.

    Words are runs of anything but ASCII white space, A-Z lower-cased and joined
    by one space.  A text of fewer words has its whole sequence as one shingle;
    a null text or one without words has none.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def simhash(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes; none: zero."""
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; the long holds the 64 bits of the fingerprint."""
    arrow_rows(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [simhash(shingle_hashes(t, size)) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks that keep ``blocks - radius`` of the blocks of a fingerprint.

    Two fingerprints that differ in at most ``radius`` bits differ in at most so
    many blocks, so they agree under one of the masks at least.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(cuts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(keep)) for keep in itertools.combinations(parts, blocks - radius)]


def fingerprint_edges(fps: DataFrame, radius: int = 2, blocks: int = 4, hot: int = 64) -> DataFrame:
    """Edges (a, b) that connect what distinct fingerprints (fp) within ``radius`` connect.

    Fingerprints join on the blocks they share and the pairs' Hamming distance
    is verified.  A block value that more than ``hot`` distinct fingerprints share is
    not joined with itself: each of those fingerprints names all values at most
    one bit away, and those that name a value, two bits apart at most, are tied to
    the least of them.  That finds the same components in rows that grow with the
    number of fingerprints (for a radius of 2; other radii have ``hot`` pairs joined).
    """
    if radius > blocks - 1 or radius < 0:
        raise ValueError("radius has to be below the number of blocks")
    masks = block_masks(radius, blocks)
    keys = save(
        fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])).alias("k"))
        .select("fp", "k.mask", "k.block"),
        "blocks",
    )
    shared = save(keys.groupBy("mask", "block").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    cold = shared if radius != 2 else shared.where(F.col("n") <= hot)
    near = save(keys.join(cold, ["mask", "block"]).select("mask", "block", "fp"), "near")
    other = near.select("mask", "block", F.col("fp").alias("b"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    pairs = near.join(other, ["mask", "block"]).where((F.col("fp") > F.col("b")) & close).select(F.col("fp").alias("a"), "b").distinct()
    if radius != 2:
        return pairs
    crowd = keys.join(shared.where(F.col("n") > hot), ["mask", "block"]).select("fp").distinct()
    one = [1 << i for i in range(63)] + [-(1 << 63)]
    names = save(crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m)) for m in one])).alias("value")), "flips")
    least = save(names.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("value", "b"), "least")
    stars = names.join(least, "value").where(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the least doc_id that links of at most ``radius`` differing bits
    reach, the row's own included.  Null and empty texts have fingerprint zero and
    link like any other; a null doc_id gets the component of its fingerprint and
    never names one.  Repeated rows are returned as often as given; other columns are
    dropped.  Only distinct fingerprints are compared.
    """
    fps = save(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(fingerprint_edges(distinct.select("fp"), radius, blocks))
    first = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = save(first.join(roots, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# --- the pipeline's stage: copies by word similarity ---------------------------------

#: Bits of the fingerprint that candidates are held against, as words of 64.
WIDE = 4
#: Differing bits of it up to which texts are candidates: 4.5 standard deviations over what a cosine of 0.8 gives.
RADIUS = 81
#: Texts of so many distinct shingles or fewer have each shingle as a block too.
SHORT = 25


def remixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Further hashes of the same shingles."""
    mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * salt % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A SimHash of 64 * WIDE bits of distinct shingles."""
    return np.array([simhash(hashes if not i else remixed(hashes, i)) for i in range(WIDE)], np.int64).tobytes()


def close_fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the Hamming distances of rows of bytes are at most RADIUS."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1) <= RADIUS


def partition_blocks(hashes: np.ndarray, blocks: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a partitioned fingerprint of distinct shingles: (numbers, values).

    The shingles are dealt into partitions by their hash, and the
    SimHash of a partition is one block of the fingerprint.  An edit touches few
    partitions, so the other blocks stay equal: where fewer shingles differ than there are partitions, one at least does.
    About ``share`` to twice as many shingles fall into each partition, half as many on a second level, and a quarter on a
    third level of texts that have fewer than ``blocks`` partitions on the second.  The fingerprint has ``blocks`` blocks of each level.
    Texts whose numbers of shingles differ by less than a factor of two have a level in common.  Each
    shingle of a short text is a block as well.
    """
    level = max(0, (len(hashes) // share).bit_length() - 1)
    # another mixture of the bits than those that the fingerprint counts
    deal = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    numbers, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lev in range(level, level + (3 if 2 << level < blocks else 2)):
        part = (deal & np.uint64((1 << lev) - 1)).astype(np.int64)
        keep = part < blocks
        part, some = part[keep], hashes[keep]
        if not len(part):
            continue
        order = np.argsort(part, kind="stable")
        part, some = part[order], some[order]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        n = np.diff(np.r_[at, len(part)])
        values.append(np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view(np.int64).ravel())
        numbers.append(part[at] + 64 * lev)
    if len(hashes) <= SHORT:
        values.append(hashes.view(np.int64))
        numbers.append(np.full(len(hashes), -1))
    return np.concatenate(numbers), np.concatenate(values)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, blocks: int = 24, share: int = 4) -> DataFrame:
    """(doc_id, digest, component_id, kept): groups of texts whose word shingles are similar.

    Similarity is what the SimHash estimates, the cosine of the sets of distinct ``size``-word shingles (their
    common shingles by the root of the product of their numbers); a Jaccard similarity of 0.8 is a cosine of 0.89.
    Distinct texts that share a block of their partitioned fingerprints are held
    against each other by the Hamming distance of whole fingerprints, and those close enough exactly (see ``common.linked``).
    Texts without words (null and empty included) form one group, whose least doc_id is component_id.  kept tells the one row
    of a group that has the least doc_id and, of several texts with it, the least digest (``text_digest``).  Rows with a
    null doc_id are left out; a row that is given again is returned again.
    """
    arrow_rows(docs.sparkSession)
    flat = lambda xs: pa.ListArray.from_arrays(np.cumsum([0, *map(len, xs)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *xs]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, marks, wide = [], [], [], []
            for text in as_bytes(batch.column(2)):
                hashes = np.unique(shingle_hashes(text, size))
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                number, value = partition_blocks(hashes, blocks, share)
                marks.append(np.unique(number * np.int64(-7046029254386353131) ^ value))
                wide.append(wide_fingerprint(hashes))
            made = [pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), flat(marks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "digest", "same", "size", "sketch", "marks"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), flat(made)], names=["node", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    with tidy() as keep:
        made = save(rows.mapInArrow(mark, "doc_id long, digest long, same binary, size long, sketch binary, marks array<long>"), "marked")
        firsts = made.groupBy("same").agg(F.min_by(F.struct("doc_id", "digest", "size", "sketch", "marks"), F.struct("doc_id", "digest")).alias("f"))
        # a node is a distinct text; two texts of one doc_id stay two nodes
        node = F.xxhash64("same")
        firsts = save(firsts.select("same", node.alias("node"), F.struct("f.doc_id", "f.digest").alias("first"), "f.size", "f.sketch", "f.marks"), "firsts")

        def sets(nodes: DataFrame) -> DataFrame:
            """Only the texts of these nodes are cut into shingles again."""
            asked = firsts.join(nodes, "node", "left_semi").select("node", "first.doc_id", "first.digest")
            return rows.join(asked, ["doc_id", "digest"]).select("node", "text").mapInArrow(cut, "node long, shingles array<long>").dropDuplicates(["node"])

        def similar(common, n, m):  # noqa: ANN001, ANN202
            return common >= threshold * np.sqrt(n * m) - 1e-9

        marks = firsts.select(F.explode("marks").alias("mark"), "node")
        found = linked(marks, firsts.select("node", "sketch", "size"), sets, close_fingerprints, similar)
        rooted = firsts.join(found, "node", "left").select("same", "first", F.coalesce("component", "node").alias("root"))
        least = rooted.groupBy("root").agg(F.min("first").alias("least"))
        groups = made.select("doc_id", "digest", "same").join(rooted.join(least, "root").select("same", "least"), "same")
        kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
        return keep(save(groups.select("doc_id", "digest", F.col("least.doc_id").alias("component_id"), kept.alias("kept")), "groups"))


def text_digest(text_col: str) -> Column:
    """A hash of a text; null has its own."""
    return F.coalesce(F.xxhash64(F.col(text_col).cast("string"), F.lit(SEED)), F.lit(0))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """One row of ``docs``, that of the least doc_id, for each group of ``similar_groups``, with all its columns.

    Where the least id has several similar texts, the one of the least digest stays.  Rows whose id is null are never
    compared and stay, each text once.
    """
    chosen = similar_groups(docs, id_col, text_col, **options).where("kept").select("doc_id", "digest").distinct()
    digest, own, other = (fresh(docs, n) for n in ("digest_here", "id_of_group", "digest_of_group"))
    named = docs.withColumn(digest, text_digest(text_col))
    joined = named.join(chosen.toDF(own, other), (named[id_col].cast("long") == F.col(own)) & (named[digest] == F.col(other)), "left")
    stay = joined.where(F.col(own).isNotNull() | F.col(id_col).isNull())
    return stay.dropDuplicates([id_col, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
