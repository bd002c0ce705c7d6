"""Documents to packed training sequences: quality rules, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradarium.llm.common import stored, table
from gradarium.llm.exact_dedup import drop_exact_copies
from gradarium.llm.mixing import mixed_documents
from gradarium.llm.ngram_join import drop_near_copies
from gradarium.llm.packing import pack
from gradarium.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null or empty text is rejected; rows are judged one by one, so ties and repeated
    rows fare alike and a doc_id may be null; texts of any length are read whole."""
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, null being greater than all; of rows that tie in it exactly one.
    A null text equals an empty one. Only row numbers are joined to the texts, of whatever length."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of their five-word shingles, the row with the smallest doc_id,
    null being greater than all, of ties exactly one. Rows without a word stay. Repeated doc_ids are rows of their own."""
    return drop_near_copies(docs, n=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: rows repeat. A null source is a source, a text without
    words is taken at the rate of its source; rows that tie in doc_id and text are taken alike."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place; every row is a document of its own, also where doc_ids
    repeat or are null. A null text is the end token alone, a long one many pieces."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix),
    ("best_fit_packing", pack_sequences),
]

#: None: token ids and near copies can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. Empty documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
