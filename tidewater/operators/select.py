"""Choosing rows before the costly steps: first, last, random, every n-th, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at_least_one(n: int) -> int:
    if n < 1:
        raise ValueError("the number of rows has to be positive")
    return n


def first(df: DataFrame, n: int, by: str = "path") -> DataFrame:
    """The first n rows by a column, in order."""
    return df.orderBy(by).limit(_at_least_one(n))


def last(df: DataFrame, n: int, by: str = "path") -> DataFrame:
    """The last n rows by a column, in rising order; all if there are fewer."""
    return df.orderBy(F.desc(by)).limit(_at_least_one(n)).orderBy(by)


def random(df: DataFrame, n: int, seed: int = 42, by: str = "path") -> DataFrame:
    """n rows without replacement, the same for the same seed however the data are partitioned, in order."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string")))
    return df.withColumn("_key", key).orderBy("_key", by).limit(_at_least_one(n)).drop("_key").orderBy(by)


def select(df: DataFrame, first_n: int | None = None, last_n: int | None = None, random_n: int | None = None, limit: int | None = None, seed: int = 42, by: str = "path") -> DataFrame:
    """At most one of the four choices; none passes all rows on."""
    given = [n is not None for n in (first_n, last_n, random_n, limit)]
    if sum(given) > 1:
        raise ValueError("only one of first, last, random and limit can be given")
    if random_n is not None:
        return random(df, random_n, seed, by)
    if last_n is not None:
        return last(df, last_n, by)
    n = first_n if first_n is not None else limit
    return df if n is None else first(df, n, by)


def every_nth(frames: DataFrame, skip: int = 1, most: int | None = None, video: str = "video_id", index: str = "frame_idx") -> DataFrame:
    """Frames whose number is a multiple of skip, at most ``most`` of each video.

    Numbers follow from the index alone, so that no ordering by video is needed.
    """
    step = max(1, skip)
    chosen = frames.where(F.col(index) % step == 0)
    return chosen.where(F.col(index) < step * most) if most else chosen


def valid(results: DataFrame, scored: bool = False) -> DataFrame:
    """Rows without an error; with ``scored`` those with a score only."""
    rows = results.where(F.col("error").isNull())
    return rows.where(F.col("overall_score").isNotNull()) if scored else rows


def kept(score: Column | str, threshold: float = 40.0) -> Column:
    """Whether a frame stays; one that could not be scored counts as 50."""
    return F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(50.0)) >= threshold


def split(df: DataFrame, by: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows by a hash of a column; the same rows for the same seed."""
    part = F.pmod(F.xxhash64(F.lit(seed), by), F.lit(10_000)) < int(share * 10_000)
    return df.where(~part), df.where(part)
