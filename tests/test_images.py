"""Files, errors, the registry, sinks, labels, learning and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.kernels import KERNELS, Image
from tidewater.functions.names import METRIC_NAMES
from tidewater.operators import assess, labels, learn, select, stats, temporal
from tidewater.sources import images, sinks, synthetic
from tidewater.streaming import ingest


def png(path, rgb):
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("survey")
    rng = np.random.default_rng(3)
    for name in ("a_001.png", "b_002.PNG"):
        png(d / name, rng.integers(0, 256, (48, 40, 3)).astype(np.uint8))
    (d / "c_003.png").write_bytes(b"no image")
    (d / "notes.txt").write_text("x")
    return d


def test_scan_assess_and_sinks(spark, folder, tmp_path):
    assert images.find_images(spark, str(folder)).count() == 3
    rows = images.read_images(spark, str(folder))
    found = assess.assess(rows).persist()
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert got["c_003.png"].error and got["c_003.png"].overall_score is None
    good = got["a_001.png"]
    assert all(np.isfinite(good[n]) for n in METRIC_NAMES) and 0 <= good.overall_score <= 90
    raw = rows.where("path like '%a_001.png'").first()
    bgr = np.frombuffer(raw["data"], np.uint8).reshape(raw.height, raw.width, 3)
    assert good.uiqm_score == pytest.approx(KERNELS["uiqm_score"](Image(bgr)))
    sinks.write_csv(sinks.csv_rows(found), str(tmp_path / "csv"))
    back = {r.filename: r.overall_score for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()}
    assert back["c_003.png"] == "ERROR" and len(back) == 3
    assert sinks.report_lines(found).count() == 2 and "Category" in sinks.report_lines(found).first().report
    assert json.loads(sinks.json_rows(assess.nested(found)).first().json)
    assert stats.summary(found).first().failed_assessments == 1
    assert sinks.pending(rows, found.where("error is null")).count() == 1
    assert images.read_paths(spark, [str(folder / "b_002.PNG"), str(folder)], [False, True]).count() == 4
    with pytest.warns(UserWarning, match="not found"):
        mixed = images.read_paths(spark, [str(folder / "gone.png"), str(folder / "b_002.PNG"), str(folder)])
    assert sorted(r.arg_pos for r in mixed.collect()) == [1, 2, 2, 2]
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        images.read_paths(spark, [str(folder / "gone.png")])


def test_one_image(spark, folder):
    found = assess.assess_image(spark, str(folder / "a_001.png"))
    rows = images.read_images(spark, str(folder)).where("path like '%a_001.png'")
    whole, raw = assess.assess(rows).first(), rows.first()
    assert found.overall_score == whole.overall_score and found.usability_category == whole.usability_category
    assert set(found.detailed_metrics.asDict()) == set(METRIC_NAMES) and found.detailed_metrics.uiqm_score == whole.uiqm_score
    bgr = np.frombuffer(raw["data"], np.uint8).reshape(raw.height, raw.width, 3)
    assert assess.assess_image(spark, bgr) == found
    assert assess.assess_image(spark, bgr[..., 0]).detailed_metrics.blue_dominance == 0
    assert assess.assess_image(spark, bgr, scale=0.5).overall_score != found.overall_score
    for bad in (str(folder / "gone.png"), str(folder / "c_003.png"), str(folder)):
        with pytest.raises(FileNotFoundError):
            assess.assess_image(spark, bad)


def test_pixels_round_trip(spark, folder):
    rows = images.read_images(spark, str(folder)).where("error is null")
    back = {r.path: bytes(r["data"]) for r in images.from_pixels(images.to_pixels(rows)).collect()}
    assert back == {r.path: bytes(r["data"]) for r in rows.collect()}


def test_registry(spark, folder):
    own = assess.MetricRegistry()
    with pytest.raises(ValueError):
        own.register_metric("rms_contrast", lambda m: 1.0)
    own.register_metric("one", lambda m: 1.25)
    assert own.registered_metrics() == ["one"]
    got = assess.measure(images.read_images(spark, str(folder)), ["edge_density"], own=own).where("error is null").first()
    assert got.custom == {"one": 1.25} and "uiqm_score" not in got.asDict()
    assert own.unregister_metric("one") and not own.unregister_metric("one")


def test_selection_rules(spark):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(10)], "path string")
    assert [r.path for r in select.select(df, last_n=3).collect()] == ["07", "08", "09"]
    assert select.random(df, 4).collect() == select.random(df.repartition(5), 4).collect()
    with pytest.raises(ValueError):
        select.select(df, first_n=1, limit=2)
    with pytest.raises(ValueError):
        select.first(df, 0)


def test_single_frame_and_empty(spark):
    kind = "video_id long, frame_idx long, overall_score double, blue_water_problem_severity double, visibility_score double"
    one = temporal.video_summary(spark.createDataFrame([(1, 0, 50.0, 1.0, None)], kind)).first()
    assert one.temporal_stability == 1.0 and one.quality_trend is None and one.visibility_avg == 0.5
    assert temporal.video_summary(spark.createDataFrame([], kind)).count() == 0


def test_labels_and_learning(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"synthetic_000000.png": {"quality_score": 80.0}, "gone.png": {"blue_water_severity": 2.0}}))
    marks = labels.with_defaults(labels.read_labels(spark, str(tmp_path / "labels.json")))
    made = synthetic.synthetic_images(spark, 24, 32)
    files = made.select(F.col("path").alias("filename"))
    assert labels.labelled(marks, files).first().blue_water_severity == 5.0
    assert [r.filename for r in labels.missing(marks, files).collect()] == ["gone.png"]
    rows = assess.measure(made, ["rms_contrast", "blue_water_severity"]).persist()
    model = learn.train_regressor(rows, features=["rms_contrast", "blue_water_severity"])
    assert learn.evaluate(learn.predict(model, rows)).first().correlation > 0.9
    got = learn.predict_images(made, lambda: lambda x: np.stack([x.mean(axis=(1, 2, 3)) * 100, x[..., 2].mean(axis=(1, 2))], axis=1), side=16)
    assert got.where("dl_score > 0 and error is null").count() == 24


def test_stream(spark, folder, tmp_path):
    query = ingest.assess_stream(ingest.arriving_images(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("error is null").count() >= 2
