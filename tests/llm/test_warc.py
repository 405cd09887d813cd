"""Archives with long fields, large pages and broken chains."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import warc
from tidewater.llm.common import scratch_path


def test_long_url_loses_no_record(spark):
    pages = spark.createDataFrame([(1, "http://a", "<x>"), (2, "http://b/" + "u" * 100_000, "<y>"), (3, "http://c/WARC/1.1", "<z>"), (4, "u", "\r\n\r\nWARC/1.1\r\nA: b")], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()} == {1: 3, 2: 3, 3: 3, 4: 18}


def test_files_are_bounded_in_bytes_and_chains_end(spark):
    pages = spark.range(40).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), F.when(F.col("id") % 4 == 0, 20_000).otherwise(10).cast("int"))).alias("html"))
    path = scratch_path(spark, "bounded")
    warc.write_archives(warc.plan_records(pages), path, per_file=20, per_file_bytes=100_000)
    assert max(r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()) <= 100_000
    assert warc.read_archives(spark, path).count() == 40
    whole = spark.read.text(path, wholetext=True).first()[0]
    cut = scratch_path(spark, "broken")
    spark.createDataFrame([(whole[:-3],)], "value string").coalesce(1).write.option("lineSep", "\n").text(cut)
    with pytest.raises(ValueError, match="records end at byte"):
        warc.read_archives(spark, cut)
