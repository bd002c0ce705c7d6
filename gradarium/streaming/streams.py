"""Scoring and moving averages on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradarium.functions.ordering import written
from gradarium.operators.boosting import BoostedModel
from gradarium.operators.detection import detections_in_rows, suppress_in_rows

DECAY = 0.9


def score_stream(stream: DataFrame, models: dict[str, BoostedModel]) -> DataFrame:
    """The stream's rows with model, score and prediction, one row for each model: models are constants of the plan."""
    parts = [m.transform(stream).withColumn("model", F.lit(name)) for name, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_stream(frames: DataFrame, features: DataFrame, sized: DataFrame, models: dict[str, BoostedModel], least: float = 0.25, average: bool = True, drop_last: bool = False) -> DataFrame:
    """(img_id, model, j, k, h, w, score): suppressed detections of each model in a stream of frames (img_id, h, w,
    pixels). Frames share one integral image between the models and are finished one by one, without state."""
    return suppress_in_rows(detections_in_rows(frames, features, sized, models), least, average, drop_last)


def detection_times(frames: DataFrame, features: DataFrame, sized: DataFrame, models: dict[str, BoostedModel]) -> DataFrame:
    """(img_id, model, n_found, integral_s, windows_s) of frames, as a stream or not: how many windows each model found and
    the seconds that it took. Their moving averages are those of moving_average_batches() with the model as key."""
    timed = detections_in_rows(frames, features, sized, models, timed=True)
    return timed.select("img_id", "model", F.size("found").alias("n_found"), "integral_s", "windows_s")


def folded(x: np.ndarray, start: float, decay: float, step: int = 256) -> np.ndarray:
    """a' = decay * a + (1 - decay) * x from a = start, after each x. Weights run over pieces of bounded length, so their
    powers stay in range."""
    out = np.empty(len(x))
    step = max(1, min(step, int(500 / -np.log(decay)))) if decay > 0 else 1
    for k in range(0, len(x), step):
        part = x[k : k + step]
        up = decay ** np.arange(1, len(part) + 1) if decay > 0 else np.zeros(len(part))
        out[k : k + step] = up * (start + (1 - decay) * np.cumsum(part / up)) if decay > 0 else part
        start = out[min(k + step, len(x)) - 1]
    return out


def moving_average(rows: DataFrame, key: str, order: str, value: str, decay: float = DECAY) -> DataFrame:
    """rows with ema: the exponential moving average of each key up to each row, corrected for its start, for batches. Ties
    in order are not defined."""
    return folded_in_ranges(rows, key, order, value, decay).drop("n", "total")


def folded_in_ranges(rows: DataFrame, key: str, order: str, value: str, decay: float = DECAY, start: DataFrame | None = None) -> DataFrame:
    """rows with ema, n and total: average, number and sum of each key's rows up to each row. start (key, average, n, total)
    is what earlier rows of some keys left; averages in it are not corrected for their start.

    Rows are dealt out by ranges of (key, order) and each range is folded from zero in one pass; the average is linear in
    where it starts, so a range's start, folded over the ranges of its key before it, is added with its weight. A key
    with most of the rows is many ranges; only a row for each key and range meets in a window."""
    ranged = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("__part", F.spark_partition_id())
    names = [*ranged.columns, "__own", "__n", "__sum"]
    at = ranged.columns.index(key), ranged.columns.index(value)
    schema = ranged.select("*", F.lit(0.0).alias("__own"), F.lit(0).cast("long").alias("__n"), F.lit(0.0).alias("__sum")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: Any = None
        average, n, total, fresh = 0.0, 0, 0.0, True
        for batch in batches:
            keys, x = batch.column(at[0]).to_pandas().to_numpy(), batch.column(at[1]).to_numpy(zero_copy_only=False).astype(np.float64)
            own, count, sums = np.empty(len(x)), np.empty(len(x), np.int64), np.empty(len(x))
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            for a, b in zip(new, np.append(new[1:], len(x))[: len(new)], strict=True):
                if fresh or keys[a] != name:
                    name, average, n, total, fresh = keys[a], 0.0, 0, 0.0, False
                own[a:b] = folded(x[a:b], average, decay)
                count[a:b] = np.arange(n + 1, n + 1 + b - a)
                sums[a:b] = np.cumsum(np.append(total, x[a:b]))[1:]
                average, n, total = own[b - 1], n + b - a, sums[b - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(count), pa.array(sums)], names)

    local = written(ranged.mapInArrow(fold, schema))
    ends = local.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.max("__n").alias("n"), F.max_by(F.struct("__own", "__sum"), "__n").alias("e"))  # a row for each key and range
    seen = F.collect_list(F.struct("n", F.col("e.__own").alias("own"), F.col("e.__sum").alias("total"))).over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("__seen", seen)
    power = lambda n: F.pow(F.lit(decay), n.cast("double"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("own"), F.lit(0.0).alias("total"))
    if start is not None:
        ends = ends.join(start.select(F.col(key).alias("__known"), F.struct(F.col("n"), F.col("average").alias("own"), "total").alias("__zero")), F.col("__key") == F.col("__known"), "left")
        zero = F.coalesce("__zero", zero)
    begin = F.aggregate("__seen", zero, lambda s, e: F.struct((s["n"] + e["n"]).alias("n"), (s["own"] * power(e["n"]) + e["own"]).alias("own"), (s["total"] + e["total"]).alias("total")))
    starts = written(ends.select("__key", "__of", begin.alias("__start")))
    out = local.join(starts, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__of")))
    n = F.col("__start.n") + F.col("__n")
    ema = (F.col("__own") + F.col("__start.own") * power(F.col("__n"))) / (F.lit(1.0) - power(n))
    return out.select(*rows.columns, ema.alias("ema"), n.alias("n"), (F.col("__start.total") + F.col("__sum")).alias("total"))


def moving_average_batches(stream: DataFrame, key: str, order: str, value: str, folder: str, decay: float = DECAY) -> DataFrame:
    """Everything a stream has now, as rows with ema, n and total, written under `folder` and read back; a later call with
    the same folder goes on where this one ended.

    Each batch is a table of its own that is folded in ranges, so neither a key's rows of a batch nor its state stand in one
    task; what each key has come to is a small table (key, average, n, total) for the next batch. Rows that come in a later
    batch than greater ones of their key are folded when they come. Results and states are named by the batch's number and
    replaced when it runs again, so each row counts once."""
    spark = stream.sparkSession
    state = f"{key_type(stream, key)}, average double, n long, total double"

    def step(rows: DataFrame, epoch: int) -> None:
        own = rows.sparkSession
        before = own.read.schema(state).parquet(f"{folder}/state/epoch={epoch - 1}") if epoch else None
        out = folded_in_ranges(rows, key, order, value, decay, before)
        path = f"{folder}/out/epoch={epoch}"
        out.write.mode("overwrite").parquet(path)
        last = own.read.schema(out.schema).parquet(path).groupBy(key).agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"), F.max_by("ema", "n").alias("ema"))
        last = last.select(key, (F.col("ema") * (F.lit(1.0) - F.pow(F.lit(decay), F.col("n").cast("double")))).alias("average"), "n", "total")
        if before is not None:
            last = last.unionByName(before.join(last, key, "left_anti"))
        last.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumns({"ema": F.lit(0.0), "n": F.lit(0).cast("long"), "total": F.lit(0.0)}).schema
    return spark.read.schema(schema).parquet(f"{folder}/out/epoch=*")


def key_type(stream: DataFrame, key: str) -> str:
    return f"`{key}` {stream.schema[key].dataType.simpleString()}"


def moving_average_stream(stream: DataFrame, key: str, order: str, value: str, decay: float = DECAY, block: int = 512) -> DataFrame:
    """(key, order, value, ema, n, total) of a stream of rows that come in order within each key from trigger to trigger;
    rows that come later than greater ones are folded when they come. Keys are strings, order is a whole number, rows
    without an order or a value are left out.

    The state of a key is the average, number and total of its rows so far. Rows of one trigger come in any order: they
    are put aside in the state, in blocks that are in order in themselves, and merged from there, so a worker holds the
    blocks that overlap and never all rows of a key. The session's state store becomes RocksDB, which this needs."""

    class Average(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.sofar = handle.getValueState("sofar", "average double, n long, total double")
            self.aside = handle.getMapState("aside", "block long", "orders binary, numbers binary")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            blocks: list[tuple[int, int]] = []
            for part in rows:
                x = part.sort_values("order", kind="stable")
                orders, numbers = x["order"].to_numpy(np.int64), x["value"].to_numpy(np.float64)
                for a in range(0, len(orders), block):
                    self.aside.updateValue((len(blocks),), (orders[a : a + block].tobytes(), numbers[a : a + block].tobytes()))
                    blocks.append((int(orders[a]), len(blocks)))
            average, n, total = self.sofar.get() if self.sofar.exists() else (0.0, 0, 0.0)
            blocks.sort()
            orders, numbers = np.zeros(0, np.int64), np.zeros(0)
            for k, (_, name) in enumerate(blocks):
                raw = self.aside.getValue((name,))
                self.aside.removeKey((name,))
                orders, numbers = np.append(orders, np.frombuffer(raw[0], np.int64)), np.append(numbers, np.frombuffer(raw[1], np.float64))
                at = np.argsort(orders, kind="stable")
                orders, numbers = orders[at], numbers[at]
                done = int(np.searchsorted(orders, blocks[k + 1][0])) if k + 1 < len(blocks) else len(orders)
                if done:
                    own, count = folded(numbers[:done], average, decay), np.arange(n + 1, n + 1 + done)
                    sums = np.cumsum(np.append(total, numbers[:done]))[1:]
                    average, n, total = float(own[-1]), int(count[-1]), float(sums[-1])
                    yield pd.DataFrame({"key": key[0], "order": orders[:done], "value": numbers[:done], "ema": own / (1 - decay ** count.astype(float)), "n": count, "total": sums})
                    orders, numbers = orders[done:], numbers[done:]
            self.sofar.update((average, n, total))

        def close(self) -> None:
            pass

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), F.col(value).cast("double").alias("value")).dropna(subset=["order", "value"])
    schema = "key string, order long, value double, ema double, n long, total double"
    return own.groupBy("key").transformWithStateInPandas(Average(), schema, "append", "none")


def run_until_quiet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Batch after batch into Parquet until the source has nothing new: for sources that are read some at a time."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, once, into Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
