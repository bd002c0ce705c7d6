"""Exact dedup by counting quotient filters, then a comparison of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradarium.llm.common import BROADCAST_ROWS, SPACE, anti_join, numbered, semi_join, stored
from gradarium.llm.quotient_filter import CountingQuotientFilter

#: Upper bits of a fingerprint that name the slice of the filter it lies in; slices merge independently. Their number
#: grows with the rows: a slice has about this many fingerprints.
SLICE_ROWS = 200_000
#: Copies of a group of equal texts where groups are too many to be broadcast.
SALTS = 32
BLOCKS = pa.schema([("block", pa.int32()), ("cqf", pa.binary())])


def _build(bits: int):
    """One filter for each slice that the partition's fingerprints touch; the upper `bits` bits name the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not sum(map(len, values)):
            return
        whole = CountingQuotientFilter.of(np.concatenate(values), 64)
        block = (whole.values >> np.uint64(64 - bits)).astype(np.int32)
        names, start = np.unique(block, return_index=True)
        ends = np.append(start[1:], len(block))
        own = np.uint64((1 << (64 - bits)) - 1)
        raw = [CountingQuotientFilter(whole.values[a:b] & own, whole.counts[a:b], 64 - bits).to_bytes() for a, b in zip(start, ends, strict=True)]
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array(raw, pa.binary())], schema=BLOCKS)

    return run


def _merge(bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The fingerprints of one slice that occur more than once over all partitions."""
        merged = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in rows["cqf"]])
        more = merged.counts > 1
        values = merged.values[more] | np.uint64(int(key[0]) << (64 - bits))
        return pd.DataFrame({"__fp": values.view(np.int64), "n": merged.counts[more]})

    return run


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """(__fp, n) of the 64-bit fingerprints (one long column of n_rows rows) that occur more than once."""
    bits = min(28, max(4, (n_rows // SLICE_ROWS).bit_length()))
    blocks = fingerprints.mapInArrow(_build(bits), "block int, cqf binary")
    return blocks.groupBy("block").applyInPandas(_merge(bits), "__fp long, n long")


def _copies(held: DataFrame, text: str, doc_id: str, broadcast_rows: int) -> DataFrame:
    """(row, sha, first, n) of the rows of a table made by `numbered`: first is (no_id, doc_id, row) of the row that
    stays of its equal texts, null where no other text is equal."""
    same = F.regexp_replace(F.coalesce(F.col("held").getField(text), F.lit("")), SPACE, " ")
    normal = held.select("row", F.col("held").getField(doc_id).alias("id"), same.alias("same"))
    thin = stored(normal.select("row", "id", F.xxhash64("same").alias("__fp"), F.sha2(F.col("same"), 256).alias("sha")), "fingerprints")
    repeated = stored(repeated_fingerprints(thin.select("__fp"), thin.count()), "repeated_fingerprints")
    asked = stored(semi_join(thin, repeated.select("__fp"), "__fp", repeated.count(), broadcast_rows).select("row", "sha"), "asked")
    candidates = semi_join(normal, asked.select("row"), "row", asked.count(), broadcast_rows)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))).alias("first")
    equal = candidates.groupBy("same").agg(first, F.count(F.lit(1)).alias("n"))
    sha = F.coalesce(F.sha2(F.col("same"), 256), F.lit(""))  # never null, so no filter on it is put before the semi join
    groups = stored(equal.where("n > 1").select(sha.alias("sha"), "first", "n"), "groups")
    rows = thin.select("row", "id", "sha")
    if groups.count() <= broadcast_rows // 8:  # hashes are eight times as long as row numbers
        return rows.join(F.broadcast(groups), "sha", "left")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # rows of one hot text go to many tasks
    return rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left").drop("salt")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; columns of docs with these names are replaced.

    Texts are equal when identical after each run of white space becomes one space; a null text is an empty one.
    Rows are numbered and stored once. Each partition counts fingerprints in quotient filters, their slices are merged
    by sorted remainders, and only texts whose fingerprint has a count above one are read again and compared, as whole
    texts (grouped by the text itself, which is summed up on the map side first, so large groups send few rows).
    keep_id is the least doc_id of the equal texts and exactly one row of a group is kept: of several with that doc_id
    the one numbered first. A null doc_id is greater than any other; where all are null, keep_id is null. Texts of any
    length are compared whole. No rows give no rows.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    held = numbered(docs, "numbered")
    found = _copies(held, text, doc_id, broadcast_rows)
    keep = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    kept = F.col("first").isNull() | (F.col("first.row") == F.col("row"))
    told = found.select("row", F.struct(keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")).alias("told"))
    return held.join(told, "row").select("held.*", "told.*")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of docs, whatever their names. Only the numbers of dropped
    rows are joined to the documents."""
    held = numbered(docs, "numbered")
    dropped = stored(_copies(held, text, doc_id, broadcast_rows).where("first.row != row").select(F.col("row").alias("__dropped")), "exact_copies")
    return anti_join(held, dropped, "row", "__dropped", broadcast_rows).select("held.*")
