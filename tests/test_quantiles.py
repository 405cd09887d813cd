"""Exact medians of many values and of odd ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import quantiles, stats


def test_images_of_doubles_keep_the_order():
    x = np.array([-np.inf, -1e308, -2.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e308, np.inf, np.nan])
    image = quantiles.ordered(x)
    assert (image[1:] > image[:-1]).all() and quantiles.ordered(np.array([-0.0])) == quantiles.ordered(np.array([0.0]))
    assert [repr(quantiles.value_of(int(i))) for i in image] == [repr(float(v)) for v in x]


def test_a_million_distinct_values(spark, monkeypatch):
    n = 1_000_001
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id") * 1e-9).otherwise(-F.col("id") * 1e3).alias("a"), F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.col("id") / 7).alias("b"))
    seen = []
    collect = quantiles.digit_counts

    def watched(*args):
        out = collect(*args)
        seen.append(max(map(len, out.values())))
        return out

    monkeypatch.setattr(quantiles, "digit_counts", watched)
    found = stats.spread(rows, ["a", "b"]).first()
    a = np.array([i * 1e-9 if i % 2 == 0 else -i * 1e3 for i in range(n)])
    b = np.array([7.0 if i % 3 == 0 else i / 7 for i in range(n) if i % 3 < 2])
    assert found.a_median == np.median(a) and found.b_median == np.median(b) and found.n == n
    assert found.a_mean == pytest.approx(a.mean()) and found.b_std == pytest.approx(b.std())
    assert len(seen) == 4 and max(seen) <= 1 << quantiles.DIGIT


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [2.0, None, 1.0, 5.0], [0.0, -0.0], [math.inf, -math.inf, 1.0], [1.0, math.nan, math.nan], [-1.5] * 7 + [2.0] * 7])
def test_both_ways_are_equal(spark, monkeypatch, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    few = stats.spread(df, ["x"]).first()
    monkeypatch.setattr(quantiles, "FEW", -1)
    many = stats.spread(df, ["x"]).first()
    assert [repr(v and v + 0.0) for v in few] == [repr(v and v + 0.0) for v in many] or values == [0.0, -0.0] and few == many
    assert set(stats.spread(df, ["x"]).columns) == {"n", "x_mean", "x_median", "x_std", "x_min", "x_max"}


def test_summary_of_scores(spark, monkeypatch):
    df = spark.createDataFrame([(float(v),) for v in range(-5, 20)] + [(None,)], "overall_score double")
    few = stats.web_summary(df).first()
    monkeypatch.setattr(quantiles, "FEW", -1)
    assert stats.web_summary(df).first() == few and few.median == 10.0 and few.successful == 19 and few.total == 26
