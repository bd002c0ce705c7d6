"""Ranks and running sums over a whole table without a single task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local session makes a
    temporary one; on a cluster executors would write to their own disks, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: later jobs neither recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/gradarium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each out: value of sums, the sum of value over the rows of the same keys up to the row's own.

    Rows are dealt out by ranges of (keys, order); each range adds what the earlier ranges of its keys hold. Rows that
    tie in keys and order share a range, so sum them up before where ties can be many."""
    ranged = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__{o}") for o, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in sums])
    own = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({o: F.sum(v).over(own) for o, v in sums.items()}).join(starts, [*keys, "__part"])
    return rows.withColumns({o: F.col(o) + F.col(f"__{o}") for o in sums}).drop("__part", *[f"__{o}" for o in sums])
