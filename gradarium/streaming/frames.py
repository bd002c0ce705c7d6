"""Frames of a camera or a video as a stream: numbered picture files, read so many a batch, each of them once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from gradarium.sources.readers import GRAY


class FrameFiles(DataSource):
    """(frame, file) of the files of a folder in the order of their names, which must not come out of order: a file that is
    added behind one that was read already is left out. Options: path, framesPerBatch, limit (frames in all, 0: no end).

    Only names pass through this source, which runs beside the driver; tasks open the files."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "frame long, file string"

    def simpleStreamReader(self, schema) -> FrameReader:  # noqa: N802
        return FrameReader(self.options["path"], int(self.options.get("framesPerBatch", "30")), int(self.options.get("limit", "0")))


class FrameReader(SimpleDataSourceStreamReader):
    """An offset is the number of frames so far and the name of the last one, so a restarted query goes on behind it."""

    def __init__(self, path: str, most: int, limit: int):
        if most < 1 or limit < 0:
            raise ValueError("framesPerBatch must be 1 or more, limit 0 or more")
        self.path, self.most, self.limit = path, most, limit

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frames": 0, "last": ""}

    def names(self) -> list[str]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        room = min(self.most, self.limit - start["frames"]) if self.limit else self.most
        new = [n for n in self.names() if n > start["last"]][: max(0, room)]
        end = {"frames": start["frames"] + len(new), "last": new[-1] if new else start["last"]}
        return iter([(start["frames"] + k, n) for k, n in enumerate(new)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        own = [n for n in self.names() if start["last"] < n <= end["last"]]
        if len(own) != end["frames"] - start["frames"]:
            raise ValueError(f"frames behind {start['last']!r} were added or removed after a batch had been planned")
        return iter([(start["frames"] + k, n) for k, n in enumerate(own)])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def gray_of(raw: bytes) -> np.ndarray:
    """The gray levels of a binary portable picture (P5: gray, P6: colours), with the usual weights."""
    fields, at = [], 0
    while len(fields) < 4:  # kind, width, height, greatest value; then one white space
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            if end >= len(raw):
                raise ValueError("not a binary portable picture")
            end += 1
        fields.append(raw[at:end])
        at = end
    kind, width, height, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or not 0 < most < 256:
        raise ValueError("not a binary portable picture of 8 bits")
    bands = 3 if kind == b"P6" else 1
    pixels = np.frombuffer(raw, np.uint8, width * height * bands, at + 1).reshape(height, width, bands)
    return np.rint(pixels.astype(np.float64) @ GRAY[::-1]).astype(np.int16) if bands == 3 else pixels[:, :, 0].astype(np.int16)


def frame_stream(spark: SparkSession, path: str, frames_per_batch: int = 30, limit: int = 0, mirror: bool = False) -> DataFrame:
    """A stream (frame, file, h, w, pixels array<smallint>) of the pictures in a folder: frames_per_batch a batch, mirrored
    from left to right if asked for, and no more after `limit` of them. Offsets are Spark's: a query that starts again from
    its checkpoint reads each frame once. The folder is one that pyarrow's file systems open."""
    spark.dataSource.register(FrameFiles)
    names = spark.readStream.format("frame_files").options(path=path, framesPerBatch=frames_per_batch, limit=limit).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for batch in batches:
            for i, name in enumerate(batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    p = gray_of(f.read())
                flat = np.ascontiguousarray(p[:, ::-1] if mirror else p).ravel()
                pixels = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *[pa.array([n], pa.int32()) for n in p.shape], pixels], ["frame", "file", "h", "w", "pixels"])

    spread = names.repartition(max(1, min(frames_per_batch, spark.sparkContext.defaultParallelism)), "frame")
    return spread.mapInArrow(run, "frame long, file string, h int, w int, pixels array<smallint>")


def write_frames(frames: DataFrame, path: str) -> int:
    """Writes images (img_id, h, w, pixels of 8 bits) as gray pictures named by their number, and tells how many. A task that
    runs again writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                number, h, w = (batch.column(c)[i].as_py() for c in range(3))
                with store.open_output_stream(f"{root}/_{number:012d}") as f:
                    f.write(f"P5 {w} {h} 255\n".encode() + batch.column(3)[i].values.to_numpy().astype(np.uint8).tobytes())
                store.move(f"{root}/_{number:012d}", f"{root}/{number:012d}.pgm")
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    written = frames.select(F.col("img_id").cast("long"), "h", "w", "pixels").mapInArrow(run, "n long")
    return written.agg(F.sum("n")).first()[0] or 0
