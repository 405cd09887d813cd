"""Ranks over many wide rows, whatever the number of ranges."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import stats


@pytest.mark.parametrize("parts", [3, 40])
def test_ranks_are_whole_and_in_order(spark, parts):
    n = 1_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        score = F.when(F.col("id") % 3 == 0, 50.0).otherwise((F.col("id") * 7919 % 100_003) / 1000.0)
        rows = spark.range(n).select(F.concat(F.lit("p"), "id").alias("path"), score.alias("overall_score"), F.repeat(F.lit("wide"), 30).alias("place"))
        found = stats.ranking(rows)
        want = rows.where("overall_score > 0").count()
        seen = found.agg(F.count("*"), F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
        assert tuple(seen) == (want, 1, want, want)
        # the score falls and the path rises from each rank to the next
        after = found.select((F.col("rank") - 1).alias("rank"), F.col("overall_score").alias("s"), F.col("path").alias("p"))
        wrong = found.join(after, "rank").where("s > overall_score or (s = overall_score and p < path)")
        assert wrong.count() == 0
        assert set(found.columns) == {"path", "overall_score", "place", "rank"}
        assert stats.ranking(rows.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
