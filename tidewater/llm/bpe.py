"""Byte-level BPE over padded numpy matrices: encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes

#: Distinct chunks of text that a worker remembers at once; it starts anew beyond that, which changes no result.
REMEMBERED = 250_000
#: Matrix cells merged at once.
CELLS = 1 << 20
#: In pieces of more bytes than this a round merges each place of the least pair, not the leftmost alone.
LONG = 256

NONE = np.int32(2**31 - 1)


class Ranks:
    """A vocabulary of byte strings with ranks, and its pairs in a hash table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.byte = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte[b] = ranks[bytes([b])]
        length = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        self.length, self.start = length, np.r_[0, np.cumsum(length)[:-1]]
        parts = [b""] * self.size
        for token, rank in ranks.items():
            parts[rank] = token
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self._table(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32))
        decimal = [str(i).encode() for i in range(self.size)]
        self.decimal_length = np.array([len(d) + 1 for d in decimal], np.int64)
        self.decimal_start = np.r_[0, np.cumsum(self.decimal_length)[:-1]]
        self.decimal_flat = np.frombuffer(b" ".join(decimal) + b" ", np.uint8)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Ranks:
        """Ranks from a file of lines ``base64 rank``, read on the driver.

        The file belongs to the installed tokenizers, not to the input; its size is fixed.
        """
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _table(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """Open addressing with linear probing, at most an eighth full."""
        self.bits = max(4, int(8 * len(made)).bit_length())
        n = 1 << self.bits
        self.keys, self.made = np.full(n, -1, np.int64), np.full(n, NONE, np.int32)
        key = (left << 32) | right
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            slots = at[todo]
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            self.keys[slots[take]] = key[todo[take]]
            self.made[slots[take]] = made[todo[take]]
            todo = todo[~take]
            at[todo] = (at[todo] + 1) & (n - 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens merge into, NONE if they don't."""
        key = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        key[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.made[at], NONE)
        todo = np.flatnonzero((there != key) & (there != -1) & (key != -2))
        at, key = at[todo], key[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == key
            out[todo[hit]] = self.made[at[hit]]
            more = ~hit & (there != -1)
            todo, at, key = todo[more], at[more], key[more]
        return out.reshape(left.shape)

    def _merge(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix (-1 pads) until no pair is left.

        Each round merges the leftmost pair of the least rank in every row and moves
        what follows one column to the left; rows that are done leave the matrix.
        """
        done_ids, done_n = ids.copy(), n.copy()
        live = np.flatnonzero(n > 1)
        ids, n = ids[live], n[live]
        pair = self.merged(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = pair.argmin(axis=1)
            row = np.arange(len(live))
            best = pair[row, at]
            over = best == NONE
            if over.any():
                done_ids[live[over], : ids.shape[1]] = ids[over]
                done_ids[live[over], ids.shape[1] :] = -1
                done_n[live[over]] = n[over]
                keep = ~over
                live, ids, n, pair, at, best = live[keep], ids[keep], n[keep], pair[keep], at[keep], best[keep]
                width = int(n.max()) if len(n) else 0
                if width < 2:
                    continue
                ids, pair = ids[:, :width], pair[:, : width - 1]
                row = np.arange(len(live))
            col = np.arange(ids.shape[1])
            ids = np.where(col[None, :] > at[:, None], np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
            ids[row, at] = best
            pair = np.where(col[None, :-1] > at[:, None], np.pad(pair[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), pair)
            n = n - 1
            # only the pairs on both sides of the merged token are new
            left = at > 0
            pair[row[left], at[left] - 1] = self.merged(ids[row[left], at[left] - 1], best[left])
            right = at < ids.shape[1] - 1
            pair[row[right], at[right]] = self.merged(best[right], ids[row[right], at[right] + 1])
        return done_ids, done_n

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long piece, with all places of the least pair in one round.

        A merged token's own pairs have higher ranks than the merge, so the rounds for
        the other places would follow one by one, from the left.
        """
        while len(ids) > 1:
            pair = self.merged(ids[:-1], ids[1:])
            best = pair.min()
            if best == NONE:
                break
            at = np.flatnonzero(pair == best)
            if len(at) > 1:  # places that overlap: from the left, every other one
                first = np.r_[True, np.diff(at) > 1]
                run = at - at[np.flatnonzero(first)][np.cumsum(first) - 1]
                at = at[run % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, by matrices of pieces of about the same length."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(length, kind="stable")
        lo = int(np.searchsorted(length[order], 1))
        while lo < len(order):
            width = int(length[order[lo]])
            if width > LONG:
                out[order[lo]] = self._merge_long(self.byte[np.frombuffer(pieces[order[lo]], np.uint8)])
                lo += 1
                continue
            most = min(LONG, width + max(1, width // 4))
            hi = min(int(np.searchsorted(length[order], most, side="right")), lo + max(1, CELLS // most))
            rows = order[lo:hi]
            n = length[rows]
            ids = np.full((len(rows), int(n.max())), -1, np.int32)
            ids[np.arange(ids.shape[1])[None, :] < n[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
            ids, n = self._merge(ids, n)
            for i, row, k in zip(rows, ids, n, strict=True):
                out[i] = row[:k]
            lo = hi
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.start, self.length, ids).tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return gather(self.decimal_flat, self.decimal_start, self.decimal_length, ids).tobytes()[:-1]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] of all of ``which``, one after the other."""
    n = length[which]
    total = int(n.sum())
    if not total:
        return flat[:0]
    shift = start[which] - np.r_[0, np.cumsum(n)[:-1]]
    return flat[np.repeat(shift, n) + np.arange(total)]


class _Numbers(dict):
    """Numbers pieces in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes whole texts, remembering the chunks that it has merged.

    A chunk is a run of spaces and line ends with the run of other characters after it. In
    texts without other white space no match of the pattern reaches from one chunk
    into the next, so a chunk's ids are the same wherever it stands; other texts are
    one chunk each and not remembered.
    """

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.odd, self.chunk = regex.compile(r"[^\S \n]"), re.compile(r"[ \n]*[^ \n]+|[ \n]+")
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        pieces = [self.split.findall(c) for c in new]
        numbers = _Numbers()
        which = np.fromiter((numbers[p] for ps in pieces for p in ps), np.int64)
        made = self.ranks.encode_pieces([p.encode("utf-8", "replace") for p in numbers])
        n = np.fromiter(map(len, made), np.int64, len(made))
        ids = gather(np.concatenate([np.zeros(0, np.int32), *made]), np.r_[0, np.cumsum(n)[:-1]], n, which)
        each = np.r_[0, np.cumsum(n[which])][np.cumsum([0, *map(len, pieces)])]
        self.start = np.r_[self.start, len(self.flat) + each[:-1]]
        self.length = np.r_[self.length, np.diff(each)]
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self._forget()
        known, once = len(self.numbers), []
        which = []
        for text in texts:
            if self.odd.search(text):
                once.append(text)
                which.append(None)
            else:
                which.append(np.fromiter(map(self.numbers.__getitem__, self.chunk.findall(text)), np.int64))
        if len(self.numbers) > known:
            self._learn(list(itertools.islice(self.numbers, known, None)))
        out = iter(self._encode_once(once))
        return [next(out) if w is None else gather(self.flat, self.start, self.length, w) for w in which]

    def _encode_once(self, texts: list[str]) -> list[np.ndarray]:
        other = object.__new__(Encoder)
        other.ranks, other.split = self.ranks, self.split
        out = []
        for text in texts:
            other._forget()
            other._learn([text])
            out.append(other.flat)
        return out


def encoder_for(ranks: Ranks, pattern: str) -> Encoder:
    """This worker's encoder: what it remembers serves its later tasks too, until the broadcast ranks go."""
    own = ranks.__dict__.setdefault("encoders", {})
    if pattern not in own:
        own[pattern] = Encoder(ranks, pattern)
    return own[pattern]


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of every row of ``docs``.

    Each match of ``pattern`` in the whole text is merged separately by the ranks in
    ``ranks_path``; no special tokens.  decoded_sha256 is the digest of the bytes that
    the ids decode to.  Null texts are encoded as empty ones; a null id and repeated
    rows are returned as given; other columns are dropped.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    shipped = spark.sparkContext.broadcast(Ranks.read(spark, ranks_path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shipped.value
        encoder = encoder_for(ranks, pattern)
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in as_bytes(batch.column(1))]
            encoded = encoder.encode(texts)
            cols = [
                batch.column(0), pa.array([len(e) for e in encoded], pa.int64()),
                pa.array([hashlib.sha256(ranks.decimals(e)).hexdigest() for e in encoded], pa.string()),
                pa.array([hashlib.sha256(ranks.decode(e)).hexdigest() for e in encoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, encoded)]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *encoded])))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of rows with token ids; null ids decode to null."""
    spark = tokens.sparkSession
    shipped = spark.sparkContext.broadcast(Ranks.read(spark, ranks_path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else shipped.value.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(each, "doc_id long, decoded binary")
