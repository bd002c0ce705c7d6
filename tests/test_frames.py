import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.streaming import frames, streams


def batches_of(spark, stream, checkpoint, most=None):
    """Frames of each batch that ran; the sink fails after `most` batches, as a lost driver would."""
    seen = []

    def take(df, epoch):
        if most is not None and len(seen) == most:
            raise RuntimeError("lost")
        seen.append([(r.frame, r.file, r.h, r.w, tuple(r.pixels)) for r in df.orderBy("frame").collect()])

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    except Exception as e:
        assert "lost" in str(e)
    finally:
        query.stop()
    return [b for b in seen if b]


def test_frames_are_read_once_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(0)
    pictures = {i: rng.integers(0, 256, (3 + i % 2, 5)) for i in range(11)}
    rows = lambda ids: spark.createDataFrame([(i, *pictures[i].shape, pictures[i].ravel().tolist()) for i in ids], "img_id long, h int, w int, pixels array<int>").repartition(3)
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    assert frames.write_frames(rows(range(7)), folder) == 7
    stream = lambda **o: frames.frame_stream(spark, folder, 3, **o)
    first = batches_of(spark, stream(), checkpoint, most=1)  # the second batch is planned and fails
    second = batches_of(spark, stream(), checkpoint)
    frames.write_frames(rows(range(7, 11)), folder)
    third = batches_of(spark, stream(limit=9), checkpoint)
    assert [len(b) for b in first] == [3] and all(len(b) <= 3 for b in second + third)
    seen = [f for b in first + second + third for f in b]
    assert [f[0] for f in seen] == list(range(9))  # each once, and no more than the limit
    for number, file, h, w, pixels in seen:
        assert file == f"{number:012d}.pgm" and (np.array(pixels).reshape(h, w) == pictures[number]).all()
    mirrored = batches_of(spark, stream(mirror=True, limit=2), f"{tmp_path}/other")
    assert [(np.array(p).reshape(h, w) == pictures[n][:, ::-1]).all() for b in mirrored for n, _, h, w, p in b] == [True, True]


def test_pictures_are_parsed(spark):
    colours = np.array([[[10, 20, 30], [255, 0, 7]]], np.uint8)
    got = frames.gray_of(b"P6\n# a note\n2 1\n255\n" + colours.tobytes())
    assert got.tolist() == np.rint(colours @ np.array([0.299, 0.587, 0.114])).tolist()
    assert frames.gray_of(b"P5 1 2 255 " + bytes([32, 10])).tolist() == [[32], [10]]
    for bad in (b"P5 1 1 65535 xx", b"P3 1 1 255 x", b"P5"):
        with pytest.raises(ValueError):
            frames.gray_of(bad)
    reader = frames.FrameReader("/tmp/not-there-at-all", 3, 0)
    assert list(reader.read(reader.initialOffset())[0]) == []
    for bad in ((0, 0), (1, -1)):
        with pytest.raises(ValueError):
            frames.FrameReader("/tmp", *bad)


def test_offsets_go_by_name(tmp_path):
    for n in ("b", "c", "e", "_hidden"):
        (tmp_path / n).write_bytes(b"")
    reader = frames.FrameReader(str(tmp_path), 2, 3)
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == [(0, "b"), (1, "c")] and end == {"frames": 2, "last": "c"}
    (tmp_path / "a").write_bytes(b"")  # behind what was read
    (tmp_path / "f").write_bytes(b"")
    rows, last = reader.read(end)
    assert list(rows) == [(2, "e")] and last["frames"] == 3 and list(reader.read(last)[0]) == []
    assert list(reader.readBetweenOffsets(end, last)) == [(2, "e")]
    (tmp_path / "d").write_bytes(b"")
    with pytest.raises(ValueError, match="added or removed"):
        reader.readBetweenOffsets(end, last)


def test_a_stream_of_frames_is_detected(spark, tmp_path):
    from gradarium.operators import detection, rectangles
    from gradarium.operators.boosting import BoostedModel

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, 16, 20, rng.integers(0, 256, 320).tolist()) for i in range(5)], "img_id long, h int, w int, pixels array<int>")
    frames.write_frames(rows, f"{tmp_path}/in")
    features, sized = rectangles.catalogue(spark, 2, 1), detection.scales(spark, 2, 8, 8, 1.3, 0.3)
    model = BoostedModel(rows=[(k, f, -40.0, 40.0, 1.0, rng.normal(size=8).tolist()) for k, f in enumerate((5, 30))], classes=[-1, 1], features=[], array_column="x", n_bins=8)
    stream = frames.frame_stream(spark, f"{tmp_path}/in", 2).withColumnRenamed("frame", "img_id")
    found = streams.detect_stream(stream, features, sized, {"m": model})
    streams.run_until_quiet(found, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").drop("model")
    want = detection.suppress(detection.detect(rows, features, sized, model), average=True)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and want.count() > 3
    assert got.agg(F.countDistinct("img_id")).first()[0] <= 5
    rows.write.parquet(f"{tmp_path}/rows")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    times = streams.detection_times(source, features, sized, {"m": model, "n": model})
    averages = streams.moving_average_batches(times, "model", "img_id", "windows_s", f"{tmp_path}/times").collect()
    assert {(r.model, r.img_id, r.n) for r in averages} == {(m, i, i + 1) for m in "mn" for i in range(5)}
    assert all(r.ema > 0 and r.integral_s >= 0 and r.total >= r.windows_s > 0 for r in averages)
    seen = {r.img_id: len(r.found) for r in detection.detections_in_rows(rows, features, sized, {"m": model}).collect()}
    assert all(r.n_found == seen[r.img_id] for r in averages)
