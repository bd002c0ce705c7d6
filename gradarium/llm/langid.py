"""Language identification by a bidirectional GRU over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradarium.llm.common import stored, utf8
from gradarium.llm.gru import ByteGRU

#: The training sample: so many labelled documents of each language at most (those of least hash).
SAMPLE_DOCS = 250
#: Languages that may be broadcast; beyond it the join with documents shuffles.
FEW_LANGUAGES = 10_000
#: Training: steps, rows of a step, bytes of a row.
STEPS, ROWS, LENGTH = 400, 160, 64
#: A longer text is read in windows of so many bytes; each also reads the bytes before and after it, whose labels
#: belong to its neighbours, so that states at its edges know what surrounds it.
WINDOW, CONTEXT = 1024, 64
#: Rows and bytes that run through the network at a time, at most: what a step computes then stays in the cache.
TOGETHER, TOGETHER_BYTES = 512, 600_000

LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    languages: list[str]
    network: ByteGRU

    def sums(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text (they lie one after the other in data) the sum of the label probabilities of all its bytes."""
        out = np.zeros((len(ends) - 1, len(self.languages)))
        pieces = []  # (text, first byte read, end of them, first own byte, end of them)
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            pieces += [(i, max(a, s - CONTEXT), min(b, s + WINDOW + CONTEXT), s, min(b, s + WINDOW)) for s in range(a, b, WINDOW)]
        pieces.sort(key=lambda p: p[2] - p[1])
        at = len(pieces)
        while at:  # the longest first; rows of a run are about as long as each other
            first = max(0, at - max(1, min(TOGETHER, TOGETHER_BYTES // (pieces[at - 1][2] - pieces[at - 1][1]))))
            own = np.array(pieces[first:at])
            sums = self.network.sums([data[a:b] for _, a, b, _, _ in pieces[first:at]], own[:, 3] - own[:, 1], own[:, 4] - own[:, 1])
            np.add.at(out, own[:, 0], sums)
            at = first
        return out


def train(texts: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """From (language, text), a text being a stretch of a document: a step draws rows of LENGTH bytes, first a language, then
    a text, then a place in it."""
    languages = sorted({lang for lang, _ in texts})
    random = np.random.default_rng(seed)
    by_label = [[np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for lang, t in texts if lang == name and t] for name in languages]
    labels = [k for k, own in enumerate(by_label) if own]
    network = ByteGRU(len(languages))
    if not labels:
        return LanguageModel(languages, network)

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _ in range(STEPS):
            y = random.choice(labels, ROWS)
            x = np.empty((ROWS, LENGTH), np.uint8)
            for i, k in enumerate(y):
                t = by_label[k][random.integers(len(by_label[k]))]
                start = random.integers(max(1, len(t) - LENGTH + 1))
                x[i] = np.resize(t[start:], LENGTH)  # a shorter text is repeated
            yield x, y

    return LanguageModel(languages, network.fit(batches()))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def training_sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> list[tuple[str, str]]:
    """(language, LENGTH characters) of at most SAMPLE_DOCS documents of each language, by hash. Training reads STEPS * ROWS
    rows of LENGTH bytes; as many are drawn by hash here, where the texts are, each document's anywhere in its whole text,
    so what reaches the driver doesn't grow with the texts. Documents are first thinned by their hash to about four
    times as many, whatever the size of the language, so the ranking below meets few rows."""
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"))
    share = stored(rows.groupBy("lang").agg((F.lit(4.0 * SAMPLE_DOCS) / F.count(F.lit(1))).alias("share")), "languages")
    rows = rows.join(F.broadcast(share) if share.count() <= FEW_LANGUAGES else share, "lang").where(F.shiftrightunsigned("h", 12) < F.col("share") * F.lit(2.0**52))
    first = stored(rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= SAMPLE_DOCS), "labelled")
    shares = first.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect()  # a row for each language
    each = {r.lang: -(-STEPS * ROWS // (len(shares) * r.docs)) for r in shares}
    counts = F.broadcast(docs.sparkSession.createDataFrame(sorted(each.items()), "lang string, places int"))
    start = lambda i: F.floor(F.pmod(F.xxhash64(F.col("h"), i), F.lit(2**52)) / F.lit(2.0**52) * (F.greatest(F.length("text") - LENGTH, F.lit(0)) + 1)).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), F.col("places")), lambda i: F.substring(F.col("text"), start(i) + 1, F.lit(LENGTH)))
    found = first.join(counts, "lang").select("lang", drawn.alias("t"))
    return sorted((r.lang, t) for r in found.collect() for t in r.t)


def score_texts(column: pa.Array, model: LanguageModel) -> tuple[list[str], list[float]]:
    """Languages and scores of a column of texts."""
    known = np.array([bool(model.languages and t and LETTER.search(t)) for t in column.to_pylist()], bool)
    langs, scores = ["und"] * len(known), [0.0] * len(known)
    if known.any():
        data, ends = utf8(column.filter(pa.array(known)))
        mean = np.minimum(model.sums(data, ends) / np.diff(ends)[:, None], 1.0)
        for i, p in zip(np.flatnonzero(known).tolist(), mean, strict=True):
            langs[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
    return langs, scores


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", model: LanguageModel | None = None) -> DataFrame:
    """docs with held_out, lang_pred and score; columns of docs with these names are replaced.

    A bidirectional GRU reads the UTF-8 bytes of each text, whatever they are, and gives every position label
    probabilities; a document has their mean over all its bytes, its language is the likeliest and score that mean. A
    text above WINDOW bytes is read in windows that see CONTEXT more bytes on both sides, so memory is bounded for a
    text of any length and every byte is labelled once. The network is trained on a bounded sample of documents whose
    crc32(doc_id) mod 3 is not 1, at places from all of their texts.
    A text that is null or has no letter is `und` with score 0, as is every text where nothing can be learned. Rows
    are judged by themselves, so repeated rows agree. A null doc_id counts as ''. No rows give no rows.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    trained = model or train(training_sample(docs, text, lang, doc_id))
    rows = docs.withColumn("held_out", held_out(F.col(doc_id)))
    names = [*rows.columns, "lang_pred", "score"]
    rows = rows.withColumn("__text", F.col(text))
    schema = rows.drop("__text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                langs, scores = score_texts(part.column(part.num_columns - 1), trained)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return rows.mapInArrow(run, schema)
