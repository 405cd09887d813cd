"""Exact medians of any number of values: rounds of histograms over the digits of doubles, never a sort or a list of values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one round; a task counts at most so many digits for each value that is looked for.
DIGIT = 16
#: Values up to which one task may hold them all, and Spark's own median is taken.
FEW = 1 << 18


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of doubles: negative zero is zero, what is no number comes last."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def value_of(number: int) -> float:
    bits = number & ~(1 << 63) if number >> 63 else ~number & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def digit_counts(rows: DataFrame, columns: Sequence[str], found: dict[str, set[int]], shift: int) -> dict[tuple[str, int], dict[int, int]]:
    """For each column and each beginning (the bits from ``shift + DIGIT`` on) how often each next digit follows."""
    asked = [(c, p) for c in columns for p in sorted(found[c])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), 1 << DIGIT), np.int64)
        for batch in batches:
            image = {c: ordered(batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)) for c in columns}
            for i, (c, begin) in enumerate(asked):
                x = image[c]
                if shift + DIGIT < 64:
                    x = x[x >> np.uint64(shift + DIGIT) == np.uint64(begin)]
                total[i] += np.bincount(((x >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
        which, digit = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[which, digit])], names=["which", "digit", "n"])

    counts = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(each, "which int, digit int, n long").groupBy("which", "digit").agg(F.sum("n").alias("n"))
    out: dict[tuple[str, int], dict[int, int]] = {a: {} for a in asked}
    for r in counts.collect():  # a row for each digit that occurs: 65,536 for each value that is looked for, at most
        out[asked[r["which"]]][r["digit"]] = r["n"]
    return out


def kth(rows: DataFrame, places: dict[str, list[int]]) -> dict[str, list[float]]:
    """The values at places (from 0, in ascending order, nulls left out) of columns, in four passes over the rows."""
    left = {(c, i): (0, k) for c, ks in places.items() for i, k in enumerate(ks)}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        counts = digit_counts(rows, list(places), {c: {left[c, i][0] for i in range(len(ks))} for c, ks in places.items()}, shift)
        for key, (begin, k) in left.items():
            for digit, n in sorted(counts[key[0], begin].items()):
                if k < n:
                    left[key] = begin << DIGIT | digit, k
                    break
                k -= n
    return {c: [value_of(left[c, i][0]) for i in range(len(ks))] for c, ks in places.items()}


def medians(rows: DataFrame, columns: Sequence[str], counts: dict[str, int]) -> dict[str, float | None]:
    """The exact median of each column, of which ``counts`` says how many values are not null; null where there is none.

    The mean of the two middle values of an even number.  Values that are no numbers are greater than all
    others.  What runs over all rows is counts of digits, so skew, ties and the number of values don't matter; rows
    that cost much to make should be written before, as they are read four times.
    """
    places = {c: sorted({(counts[c] - 1) // 2, counts[c] // 2}) for c in columns if counts[c]}
    found = kth(rows, places) if places else {}
    return {c: sum(found[c]) / len(found[c]) if c in found else None for c in columns}


def with_medians(rows: DataFrame, columns: Sequence[str], told: DataFrame, counts: dict[str, str], names: dict[str, str]) -> DataFrame:
    """The single row ``told`` with the medians of ``columns`` of ``rows``, named by ``names``; ``counts`` names its counts of values that are not null."""
    row = told.first()
    every = {c: row[counts[c]] for c in columns}
    if max(every.values(), default=0) <= FEW:
        small = rows.agg(*[F.median(c).alias(names[c]) for c in columns])
        return told.crossJoin(small)  # one row each
    found = medians(rows, columns, every)
    return told.select("*", *[F.lit(found[c]).cast("double").alias(names[c]) for c in columns])
