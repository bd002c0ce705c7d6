"""Main text of web pages: boosted trees over DOM nodes, then a choice that no ancestor contradicts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradarium.llm.boosted_trees import BoostedTrees
from gradarium.llm.dom import Page, decode, page_text
from gradarium.llm.page_templates import Maker

#: Made pages that the classifier is trained on, and their seed.
TRAINING_PAGES, SEED = 1200, 11


def labelled_page(html: str) -> tuple[np.ndarray, np.ndarray, Page]:
    """Features and labels (1: main text, or has some below) of the nodes with text of a made page."""
    page = Page(html)
    label = np.zeros(len(page.tag))
    for k in range(1, len(label)):
        own = re.search(r'data-main="([01])"', page.attributes[k])
        named = own is None and 'class="comment"' in page.attributes[k]
        label[k] = float(own[1]) if own else 0.0 if named else label[page.parent[k]]
    for k in range(len(label) - 1, 0, -1):
        label[page.parent[k]] = max(label[page.parent[k]], label[k])
    return page.features(), label, page


@lru_cache(maxsize=2)
def trained(n_pages: int = TRAINING_PAGES, seed: int = SEED) -> BoostedTrees:
    maker = Maker(seed)
    x, y = [], []
    for _ in range(n_pages):
        features, label, page = labelled_page(maker.page())
        told = np.array(page.text) > 0
        x.append(features[told])
        y.append(label[told])
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: list[str], model: BoostedTrees) -> list[str]:
    cache: dict = {}
    parsed = [Page(h, cache) for h in pages]
    if not parsed:
        return []
    margin = model.margin(np.concatenate([p.features() for p in parsed]))
    out, at = [], 0
    for p in parsed:
        n = len(p.tag)
        out.append(page_text(p, decode(p.parent, np.array(p.own, np.float64), margin[at : at + n])))
        at += n
    return out


def main_text(pages: DataFrame, html: str = "html", model: BoostedTrees | None = None) -> DataFrame:
    """pages with text and n_chars; columns of pages with these names are replaced.

    A page is parsed into block elements; scripts, styles, comments and markup never are text. Boosted trees give each
    element a chance to be main text from its subtree's density of text and links, the tokens of its attributes and
    tag and of those above it, its depth and its siblings. Then the likeliest set of kept elements is taken in which
    nothing is kept below a dropped element. Character references are decoded, white space in a block becomes one
    space, blocks are joined by one space in page order; nothing is cut off.
    A null or empty page has an empty text. A page without markup is one block. Rows are judged by themselves.
    """
    pages = pages.drop("text", "n_chars")
    trees = model or trained()
    names = [*pages.columns, "text", "n_chars"]
    at = pages.columns.index(html)
    schema = pages.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = extract([h or "" for h in part.column(at).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return pages.mapInArrow(run, schema)
