"""Videos and pictures as files: what is written is read back, and nothing is left of what fails."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.kernels import KERNELS, Image, canny
from tidewater.functions.colour import np_grey
from tidewater.operators import assess, pictures, temporal
from tidewater.sources import images, video
from tidewater.sources.pictures import write_pictures

KIND = "video_id string, frame_idx long, height int, width int, channels int, data binary, error string"


def frames(n=23, h=9, w=7, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, h, w, 3)).astype(np.uint8)


@pytest.fixture(scope="module")
def made(spark):
    return {"reef": frames(), "wreck": frames(5, 6, 8, 2), "sand": frames(1, 1, 1, 3)}


@pytest.fixture(scope="module")
def table(spark, made):
    rows = [(v, i, f.shape[0], f.shape[1], 3, f.tobytes(), None) for v, fs in made.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows + [("reef", 99, None, None, None, None, "bad")], KIND).repartition(6)


@pytest.fixture(scope="module")
def folder(spark, table, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("clips") / "out")
    video.write_clips(table, d, fps=25.0)
    return d


def test_round_trip(spark, made, folder):
    assert sorted(os.listdir(folder)) == ["reef.avi", "sand.avi", "wreck.avi"]
    got = video.read_clips(spark, folder).collect()
    assert len(got) == 29 and all(r.fps == 25.0 and r.error is None and r.t == r.frame_idx / 25.0 for r in got)
    for r in got:
        assert bytes(r["data"]) == made[r.video_id][r.frame_idx].tobytes() and r.total_frames == len(made[r.video_id])


def test_only_chosen_frames_are_dealt(spark, folder, monkeypatch):
    got = video.read_clips(spark, f"{folder}/reef.avi", every=4, max_frames=3)
    assert sorted(r.frame_idx for r in got.collect()) == [0, 4, 8]
    assert video.read_clips(spark, f"{folder}/reef.avi", every=0).count() == 23
    assert len(video.ClipReader({"path": folder}).partitions()) == 1  # short clips share a task
    monkeypatch.setattr(video, "SPLIT", 3 * 216)
    parts = [f for p in video.ClipReader({"path": f"{folder}/reef.avi", "every": "2", "max_frames": "7"}).partitions() for f in p.frames]
    assert [list(p.numbers) for p in parts] == [[0, 2, 4], [6, 8, 10], [12]] and all(len(p.places) == len(p.numbers) for p in parts)


def test_segments_and_gaps(spark, made, tmp_path):
    df = spark.createDataFrame([("v", i, 9, 7, 3, f.tobytes(), None) for i, f in enumerate(made["reef"]) if i % 3], KIND)
    video.write_clips(df, str(tmp_path / "s"), segment=10)
    assert sorted(os.listdir(tmp_path / "s")) == ["v_0000.avi", "v_0001.avi", "v_0002.avi"]
    got = {(r.video_id, r.frame_idx): bytes(r["data"]) for r in video.read_clips(spark, str(tmp_path / "s")).collect()}
    assert got[("v_0001", 0)] == made["reef"][10].tobytes() and len(got) == 15


def y4m(path, space, planes, head="F30:1", mark=b"FRAME\n"):
    h, w = planes[0][0].shape
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} {head} Ip C{space}\n".encode() + b"".join(mark + b"".join(p.tobytes() for p in frame) for frame in planes))


def test_y4m(spark, tmp_path):
    rng = np.random.default_rng(4)
    p = lambda *shape: rng.integers(16, 236, shape).astype(np.uint8)
    mono = [(p(5, 6),) for _ in range(3)]
    y4m(tmp_path / "m.y4m", "mono", mono, "F30000:1001")
    y4m(tmp_path / "f.Y4M", "420jpeg", [(p(5, 7), p(3, 4), p(3, 4)) for _ in range(2)], "F0:0", b"FRAME Ixyz\n")
    grey = [(np.full((4, 4), 126, np.uint8), np.full((4, 2), 128, np.uint8), np.full((4, 2), 128, np.uint8))]
    y4m(tmp_path / "g.y4m", "422", grey)
    (tmp_path / "bad.y4m").write_bytes(b"YUV4MPEG2 W4 H4 Cxyz\n")
    (tmp_path / "cut.y4m").write_bytes((tmp_path / "m.y4m").read_bytes()[:-7])
    got = {(r.video_id, r.frame_idx): r for r in video.read_clips(spark, str(tmp_path)).collect()}
    assert [bytes(got[("m", i)]["data"]) for i in range(3)] == [np.repeat(f[0][..., None], 3, axis=2).tobytes() for f in mono]
    assert got[("m", 0)].fps == pytest.approx(29.97, abs=0.001) and got[("f", 1)].fps == 30.0
    assert set(bytes(got[("g", 0)]["data"])) == {128}  # 1.164383 * 110 = 128.08
    assert got[("bad", None)].error and got[("cut", 2)].error == "the frame is cut off" and got[("cut", 1)].error is None
    assert len(bytes(got[("f", 0)]["data"])) == 5 * 7 * 3


def test_missing_and_unreadable(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError|PATH"):
        video.read_clips(spark, str(tmp_path / "none.avi")).count()
    (tmp_path / "x.avi").write_bytes(b"no video")
    with pytest.raises(Exception, match="neither"):
        video.read_clips(spark, str(tmp_path / "x.avi")).count()
    (tmp_path / "e.y4m").write_bytes(b"YUV4MPEG2 W4 H4 F25:1 Cmono\n")
    with pytest.raises(Exception, match="no frames"):
        video.read_clips(spark, str(tmp_path / "e.y4m")).count()
    os.mkdir(tmp_path / "empty")
    assert video.read_clips(spark, str(tmp_path / "empty")).count() == 0


def test_summary_of_a_file_equals_that_of_the_frames(spark, made, table, folder):
    def summary(rows):
        found = assess.assess(rows.withColumn("path", F.concat_ws("/", "video_id", F.col("frame_idx").cast("string"))).select("path", "video_id", "frame_idx", "height", "width", "channels", "data", "error"))
        return sorted(map(repr, temporal.video_summary(found.where("error is null")).collect()))

    assert summary(video.read_clips(spark, folder, every=5, max_frames=3)) == summary(table.where("frame_idx % 5 = 0 and frame_idx < 15"))


def test_failed_write_leaves_nothing(spark, tmp_path):
    rows = [("v", 0, 4, 4, 3, bytes(48), None), ("v", 1, 4, 5, 3, bytes(60), None)]
    with pytest.raises(Exception, match="differ in size"):
        video.write_clips(spark.createDataFrame(rows, KIND), str(tmp_path / "w"))
    assert not (tmp_path / "w").exists() or os.listdir(tmp_path / "w") == []


def test_avi_of_other_depths(spark, tmp_path):
    """Eight bits from the top down, 32 bits from the bottom up, and chunks of sound between the frames."""
    body = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    for name, depth, height, step in (("grey", 8, -3, 4), ("four", 32, 3, 20)):
        form = struct.pack("<IiiHHIIiiII", 40, 5 if depth == 32 else 4, height, 1, depth, 0, 0, 0, 0, 0, 0)
        strh = b"vids" + bytes(16) + struct.pack("<II", 1, 12) + bytes(28)
        head = body(b"LIST", b"hdrl" + body(b"avih", bytes(56)) + body(b"LIST", b"strl" + body(b"strh", strh) + body(b"strf", form)))
        raw = [bytes(range(k, k + step * 3)) for k in (1, 9)]
        movi = b"movi" + body(b"00db", raw[0]) + body(b"01wb", b"abc") + body(b"00db", raw[1])
        whole = b"AVI " + head + body(b"LIST", movi)
        (tmp_path / f"{name}.avi").write_bytes(body(b"RIFF", whole))
    got = {(r.video_id, r.frame_idx): r for r in video.read_clips(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got[("grey", 0)].fps == 12.0
    assert bytes(got[("grey", 1)]["data"]) == np.repeat(np.arange(9, 21, dtype=np.uint8), 3).tobytes()
    want = np.arange(1, 61, dtype=np.uint8).reshape(3, 5, 4)[::-1, :, :3]
    assert bytes(got[("four", 0)]["data"]) == want.tobytes()


def test_pictures(spark, made, table, tmp_path):
    rows = table.withColumn("path", F.format_string("d/%s_%03d.JPG", "video_id", "frame_idx"))
    write_pictures(rows, str(tmp_path / "p"))
    assert len(os.listdir(tmp_path / "p")) == 29
    back = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path / "p")).collect()}
    assert bytes(back["reef_004.png"]["data"]) == made["reef"][4].tobytes()
    with pytest.raises(Exception, match="same file name"):
        write_pictures(rows, str(tmp_path / "q"), F.lit("one.png"))
    assert not (tmp_path / "q").exists() or os.listdir(tmp_path / "q") == []
    bad = spark.createDataFrame([("a", 1, 1, 3, b"xyz"), ("b", 9, 9, 3, b"xyz")], "path string, height int, width int, channels int, data binary")
    with pytest.raises(Exception, match="no pixels"):
        write_pictures(bad, str(tmp_path / "r"))
    assert not (tmp_path / "r").exists() or os.listdir(tmp_path / "r") == []


def test_edges(spark, table, made, tmp_path):
    rows = table.where("video_id = 'reef'").withColumn("path", F.format_string("%03d.png", "frame_idx"))
    mask = canny(np_grey(made["reef"][3]))
    got = {r.path: r for r in pictures.edge_maps(rows).collect()}
    assert got["003.png"].channels == 1 and bytes(got["003.png"]["data"]) == (mask * np.uint8(255)).tobytes()
    assert got["099.png"].error == "bad" and got["099.png"]["data"] is None
    pair = {r.path: r for r in pictures.side_by_side(rows).collect()}["003.png"]
    both = np.frombuffer(pair["data"], np.uint8).reshape(9, 14, 3)
    assert (both[:, :7] == made["reef"][3]).all() and (both[:, 7:][mask] == (0, 255, 255)).all() and (both[:, 7:][~mask] == made["reef"][3][~mask]).all()
    write_pictures(pictures.edge_maps(rows), str(tmp_path / "e"))
    back = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path / "e")).collect()}
    assert back["003.png"].channels == 1 and KERNELS["edge_density"](Image(made["reef"][3])) == pytest.approx(mask.mean())
    text = assess.assess(rows.where("error is null")).select(pictures.caption().alias("t")).first().t
    assert text.startswith("Quality: ") and text.count("\n") == 5


def test_one_pass_fills_the_folders_of_all_surveys(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("channels"), F.unhex(F.lit("0708")).alias("data"))
    folder = F.when(F.col("path") != "5", F.concat(F.lit("s"), F.col("path").cast("long") % 2))
    write_pictures(rows, str(tmp_path / "all"), F.concat(F.lit("p"), (F.col("path").cast("long") / 2).cast("int")), folder)
    found = sorted(str(f.relative_to(tmp_path / "all")) for f in (tmp_path / "all").rglob("*") if f.is_file())
    assert found == ["p2.png", "s0/p0.png", "s0/p1.png", "s0/p2.png", "s1/p0.png", "s1/p1.png"]
    with pytest.raises(Exception, match="no name for a file"):
        write_pictures(rows, str(tmp_path / "out"), folder=F.lit(".."))
