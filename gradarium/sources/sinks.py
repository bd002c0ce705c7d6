"""Sinks of data sets, models and result tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Writes df in a format that Spark writes; JSON lines stand for text models, parquet for data sets."""
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_json_objects(df: DataFrame, key: str, value: str, path: str) -> None:
    """Writes (key, value) as text files that hold one JSON object each, a file for each partition that has rows: value is
    written as it is, so it must be JSON itself. json_scan.json_entries() reads them back in byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "{"
        for batch in batches:
            lines = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines.append(f"{mark}{json.dumps(k)}: {v}")
                mark = ","
            yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
        if mark == ",":
            yield pa.record_batch([pa.array(["}"])], ["value"])

    df.select(F.col(key).cast("string"), F.col(value).cast("string")).mapInArrow(run, "value string").write.text(path)
