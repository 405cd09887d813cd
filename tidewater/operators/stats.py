"""Batch statistics, rankings and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_path
from .quantiles import with_medians


def distribution(results: DataFrame, category: str = "usability_category", by: Sequence[str] = ()) -> DataFrame:
    """(by..., category, n, percentage): count and share of each category that occurs."""
    counts = results.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("n"))
    if by:
        whole = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        joined = counts.join(whole, list(by))
    else:
        joined = counts.crossJoin(counts.agg(F.sum("n").alias("total")))  # a single row
    return joined.select(*by, category, "n", (F.col("n") * 100.0 / F.col("total")).alias("percentage"))


def summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) of counts, means and the categories' counts; no row where nothing is valid.

    results: rows with error, overall_score, feature_usefulness_score, marine_science_value,
    blue_water_problem_severity and usability_category.
    """
    ok = F.col("error").isNull()
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    names = ("Excellent", "Good", "Fair", "Poor", "Unusable")
    count = [F.count_if(ok & (F.col("usability_category") == n)) for n in names]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in zip(names, count, strict=True)])
    found = results.groupBy(*by).agg(
        F.count("*").alias("total_images"), F.count_if(ok).alias("successful_assessments"), F.count_if(~ok).alias("failed_assessments"),
        mean("overall_score").alias("average_overall_score"), mean("feature_usefulness_score").alias("average_feature_usefulness"),
        mean("marine_science_value").alias("average_marine_value"), mean("blue_water_problem_severity").alias("average_blue_water_severity"),
        entries.alias("entries"),
    ).where("successful_assessments > 0")
    return found.withColumn("category_distribution", F.map_from_entries(F.filter("entries", lambda e: e["value"] > 0))).drop("entries")


def spread(results: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population deviation, least and largest value of columns.

    Without ``by`` medians of many values are found by histograms (``quantiles``), for which the columns are written once;
    with it, the distinct values of one group meet in one task.
    """
    parts = lambda median: [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), *median(c), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    if by:
        return results.groupBy(*by).agg(F.count("*").alias("n"), *parts(lambda c: [F.median(c).alias(f"{c}_median")]))
    rows = written(results.select(*[F.col(c).cast("double").alias(c) for c in columns]), "spread")
    told = rows.agg(F.count("*").alias("n"), *parts(lambda c: []), *[F.count(c).alias(f"{c}_count") for c in columns])
    found = with_medians(rows, columns, told, {c: f"{c}_count" for c in columns}, {c: f"{c}_median" for c in columns})
    return found.select("n", *[f"{c}_{what}" for c in columns for what in ("mean", "median", "std", "min", "max")])


def top(results: DataFrame, n: int = 10, score: str = "overall_score", tie: str = "path") -> DataFrame:
    """The best n, best first."""
    return results.where(F.col(score).isNotNull()).orderBy(F.desc(score), tie).limit(n)


def bottom(results: DataFrame, n: int = 10, score: str = "overall_score", tie: str = "path") -> DataFrame:
    """The worst n, worst last."""
    return results.where(F.col(score).isNotNull()).orderBy(score, F.desc(tie)).limit(n).orderBy(F.desc(score), tie)


def high_quality(results: DataFrame, n: int = 10, above: float = 70.0, tie: str = "path") -> DataFrame:
    """Of the best n those above a score."""
    return top(results, n, tie=tie).where(F.col("overall_score") > above)


def low_quality(results: DataFrame, below: float = 30.0, tie: str = "path") -> DataFrame:
    return results.where(F.col("overall_score") < below).orderBy(F.desc("overall_score"), tie)


def severe_blue_water(results: DataFrame, above: float = 7.0, tie: str = "path") -> DataFrame:
    return results.where(F.col("blue_water_problem_severity") > above).orderBy(tie)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where one side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ranking(results: DataFrame, score: str = "overall_score", tie: str = "path") -> DataFrame:
    """Successful rows (a score above zero) with their rank from 1, best first; equal rows are ranked in any order.

    The rows are written once, in the order that they come in; only their scores and ties are sorted, in ranges, and
    written so that the places in a range and the number of rows in the ranges before it come from
    the same ranges.  No task sees all rows.
    """
    row, place = fresh(results, "row"), fresh(results, "place")
    rows = written(results.where(F.col(score) > 0).withColumn(row, F.monotonically_increasing_id()), "ranked")
    best = (F.desc(score), F.asc(tie))
    dealt = written(rows.select(row, score, tie).repartitionByRange(*best).sortWithinPartitions(*best).select(row, F.monotonically_increasing_id().alias(place)), "places")
    part = F.shiftright(place, 33)
    counts = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    ahead, before = {}, 0
    for p in sorted(counts):
        ahead[p] = before
        before += counts[p]
    if not ahead:
        return rows.withColumn("rank", F.lit(0).cast("long")).drop(row)
    offset = F.create_map(*[F.lit(x).cast("long") for p in ahead for x in (p, ahead[p])])
    ranks = dealt.select(row, (F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1 + offset[part]).alias("rank"))
    return rows.join(ranks, row).drop(row)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table in the folder that driver and executors share and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def web_summary(results: DataFrame, score: str = "overall_score") -> DataFrame:
    """Counts and spread of the rows with a score above zero; the scores are written once."""
    rows = written(results.select(F.when(F.col(score) > 0, F.col(score).cast("double")).alias("x")), "scores")
    told = rows.agg(F.count("*").alias("total"), F.count("x").alias("successful"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("largest"), F.stddev_pop("x").alias("std"))
    return with_medians(rows, ["x"], told, {"x": "successful"}, {"x": "median"}).select("total", "successful", "mean", "median", "least", "largest", "std")


def batch_means(rows: DataFrame, batch: str, columns: Sequence[str]) -> DataFrame:
    """Means over batches of the batches' own means: a short last batch weighs as much as a full one."""
    per = rows.groupBy(batch).agg(*[F.avg(c).alias(c) for c in columns])
    return per.agg(F.count("*").alias("batches"), *[F.avg(c).alias(c) for c in columns])
