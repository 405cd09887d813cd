"""Vectors as short codes: a codebook for each part of them, found by rounds of assignment and means, searched by vantage-point trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Steps of a component's unit; a power of two, so that scaling is exact.
SCALE = 4096
#: Labels whose totals are sent to every task; more of them are joined by a shuffle.
MOST_LABELS = 100_000

Book = list[list[tuple[int, ...]]]


def usable(vector: str, dims: int | None = None) -> Column:
    """Vectors that are not null and hold only finite numbers (of the given length)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    return ok if dims is None else ok & (F.size(vector) == dims)


def whole(scaled: np.ndarray) -> np.ndarray:
    """Doubles that hold integers, as integers: Python's own where they or the squares of their differences need over 63 bits."""
    most = int(np.abs(scaled).max(initial=0))
    return scaled.astype(np.int64) if fits(most, scaled.shape[1]) else np.vectorize(int, otypes=[object])(scaled)


def fits(most: int, dims: int) -> bool:
    return 4 * dims * most * most < 1 << 62


def root(square: int | np.ndarray) -> int | np.ndarray:
    """A whole number that is the square root's floor or at most one less, so never above the root."""
    if isinstance(square, np.ndarray):
        if square.dtype == object:
            return np.array([math.isqrt(x) for x in square], object)
        return np.maximum(np.sqrt(square.astype(np.float64)).astype(np.int64) - 1, 0)
    return math.isqrt(square)


@dataclass
class Ball:
    """A vantage point and the entries nearer to and farther from it, each in a shell of distances rounded outwards."""

    entry: int
    near: Ball | None = None
    far: Ball | None = None
    near_shell: tuple[int, int] = (0, 0)
    far_shell: tuple[int, int] = (0, 0)

    @staticmethod
    def of(book: list[tuple[int, ...]], entries: list[int]) -> Ball | None:
        if not entries:
            return None
        at, rest = entries[0], entries[1:]
        square = {e: sum((a - b) ** 2 for a, b in zip(book[e], book[at], strict=True)) for e in rest}
        rest.sort(key=lambda e: (square[e], e))
        halves = rest[: (len(rest) + 1) // 2], rest[(len(rest) + 1) // 2 :]
        shells = [(root(square[h[0]]), root(square[h[-1]]) + 1) if h else (0, 0) for h in halves]
        return Ball(at, Ball.of(book, halves[0]), Ball.of(book, halves[1]), *shells)


class Nearest:
    """For each row the nearest entry of one part's codebook: least squared distance, then least index, in whole numbers."""

    def __init__(self, book: list[tuple[int, ...]]) -> None:
        self.tree = Ball.of(book, list(range(len(book))))
        most = max((abs(x) for entry in book for x in entry), default=0)
        self.most, self.book = most, book

    def search(self, parts: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances) of the rows of ``parts``; a subtree is visited unless its shell is surely farther than the best so far."""
        small = parts.dtype != object and fits(max(self.most, int(np.abs(parts).max(initial=0))), dims)
        kind = np.int64 if small else object
        book = np.array(self.book, kind).reshape(len(self.book), parts.shape[1])
        parts = parts.astype(kind)
        code = np.full(len(parts), len(book), np.int64)
        best = np.full(len(parts), np.iinfo(np.int64).max if small else 1 << 4096, kind)

        def visit(ball: Ball | None, rows: np.ndarray) -> None:
            if ball is None or not len(rows):
                return
            diff = parts[rows] - book[ball.entry]
            square = (diff * diff).sum(axis=1) if diff.shape[1] else np.zeros(len(rows), kind)
            better = (square < best[rows]) | ((square == best[rows]) & (ball.entry < code[rows]))
            best[rows[better]], code[rows[better]] = square[better], ball.entry
            low = root(square)
            high = low + 2
            inside = (low <= ball.near_shell[1]).astype(bool)
            for child, (least, most), mine in ((ball.near, ball.near_shell, inside), (ball.far, ball.far_shell, True), (ball.near, ball.near_shell, ~inside)):
                gap = np.maximum(np.maximum(low - most, least - high), 0)
                visit(child, rows[(gap * gap <= best[rows]).astype(bool) & mine])

        visit(self.tree, np.arange(len(parts)))
        return code, best


@dataclass
class Codebooks:
    """Entries of each part position, and what it takes to code a vector by them."""

    books: Book
    dims: int

    @property
    def width(self) -> int:
        return self.dims // len(self.books)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def assigned(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(parts, entries, squared distances) of each part position, for a column of usable vectors."""
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = whole(np.floor(flat * SCALE).reshape(len(column), self.dims))
        for p, book in enumerate(self.books):
            part = rows[:, p * self.width : (p + 1) * self.width]
            yield part, *Nearest(book).search(part, self.dims)


def first_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> Codebooks | None:
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("i").asc_nulls_last(), F.col("v")]
    one = rows.orderBy(*order).limit(1).collect()
    if not one:
        return None
    dims = len(one[0].v)
    start = [[math.floor(x * SCALE) for x in r.v] for r in rows.where(F.size("v") == dims).orderBy(*order).limit(entries).collect()]
    w = dims // parts
    return Codebooks([[tuple(v[p * w : (p + 1) * w]) for v in start] for p in range(parts)], dims)


def refined(vectors: DataFrame, vector_col: str, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, then each entry to the floor of its parts' mean; tasks send only sums."""
    w, k = books.width, len(books.books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books.books), k, w + 1), object)
        for batch in batches:
            for p, (part, code, _) in enumerate(books.assigned(batch.column(0))):
                for e in np.unique(code):
                    mine = part[code == e]
                    total[p, e, :w] += mine.sum(axis=0)
                    total[p, e, w] += len(mine)
        flat = total.reshape(-1)
        some = np.flatnonzero(flat != 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([int(x) for x in flat[some]], pa.decimal128(38, 0))], names=["place", "total"])

    rows = vectors.where(usable(vector_col, books.dims)).select(vector_col)
    found = rows.mapInArrow(sums, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    total = np.zeros(len(books.books) * k * (w + 1), object)
    for r in found.collect():
        total[r.place] = int(r.total)
    total = total.reshape(len(books.books), k, w + 1)
    made = [[tuple(s // n for s in total[p, e, :w]) if (n := total[p, e, w]) else old for e, old in enumerate(book)] for p, book in enumerate(books.books)]
    return Codebooks(made, books.dims)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of all usable vectors: the parts of those of the least ids, then ``rounds`` of assignment and means.

    Each round is one pass over the vectors; only sums of ``parts * entries`` entries leave a
    task or reach the driver.  The vectors' length is that of the least id whose length ``parts`` divides; None if there is no such vector.
    """
    books = first_books(vectors, id_col, vector_col, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(vectors, vector_col, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every usable vector: entries in part order, two hex digits each, and the sum of squared distances."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(books.assigned(batch.column(2)))
            codes = np.stack([code for _, code, _ in found], axis=1).astype(np.uint8)
            error = sum(square for _, _, square in found)
            cols = [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([int(e) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])

    rows = vectors.where(usable(vector_col, books.dims)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector_col)
    return rows.mapInArrow(each, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, approximate array<double>): the vectors that the codes of ``encode`` stand for."""
    entry = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in book]) for book in books.books])
    at = F.transform(F.sequence(F.lit(0), F.lit(len(books.books) - 1)), lambda p: F.get(F.get(entry, p), F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.select("vec_id", F.flatten(at).alias("approximate"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector, by codebooks fitted to all of them.

    Components x become floor(4096 x) and all else is exact in whole numbers.  Vectors that are null or
    hold null or non-finite components are dropped, and so are those of another length than the usable
    one of the least id whose length ``parts`` divides.  Fewer vectors than ``entries`` give as many
    entries.  Ties between equal ids among the first entries go by the vectors, null ids come last; repeated
    rows are rows of their own; an empty table gives no rows.  label_error sums the errors of equal labels, nulls together.
    An error over a long's range raises.  Ids are cast to long; other columns are dropped.
    """
    books = fit(vectors, id_col, vector_col, parts, entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = save(encode(vectors, books, id_col, vector_col, label_col), "codes")
    totals = save(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    told = F.broadcast(totals) if totals.count() <= MOST_LABELS else totals
    found = rows.join(told, F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
