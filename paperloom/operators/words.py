"""Documents against items by their bags of words, a document at a time: rows don't leave their task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from paperloom.functions.text import word_ratio
from paperloom.operators.batches import pieces, small_batches

#: Numbers of a piece's documents times items, and bytes of its texts, but for a document that is larger itself.
CELLS, BYTES = 2**17, 2**20


class Bags:
    """The items' words: for each word the items that have it, and how often. Items are in the order of their ids, null first."""

    def __init__(self, items: DataFrame):
        held = items.select("item_id", "text").orderBy("item_id", "text").toArrow()
        self.ids = held.column(0).combine_chunks()
        self.words = [(t or "").split() for t in held.column(1).to_pylist()]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.places: dict[str, int] = {}
        of = [(self.places.setdefault(w, len(self.places)), k, n) for k, ws in enumerate(self.words) for w, n in Counter(ws).items()]
        word, self.item, self.often = np.array(sorted(of), np.int64).reshape(-1, 3).T
        self.ends = np.searchsorted(word, np.arange(len(self.places)), "right")
        self.starts = np.searchsorted(word, np.arange(len(self.places)), "left")

    def bounds(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document and item the sum of the smaller counts and the bound, and the documents' lengths."""
        n, m = len(texts), len(self.lengths)
        get = self.places.get
        found = np.array([(k, w, c) for k, ws in enumerate(texts) for x, c in Counter(ws).items() if (w := get(x)) is not None], np.int64).reshape(-1, 3)
        doc, word, count = found.T
        each = self.ends[word] - self.starts[word]
        at = np.arange(each.sum()) + np.repeat(self.starts[word] - np.cumsum(each) + each, each)
        both = np.minimum(self.often[at], np.repeat(count, each))
        common = np.bincount(np.repeat(doc, each) * m + self.item[at], weights=both, minlength=n * m).astype(np.int64).reshape(n, m)
        lengths = np.array([len(ws) for ws in texts], np.int64)
        sums = lengths[:, None] + self.lengths
        return common, np.where(sums == 0, 1.0, common * 2.0 / np.maximum(sums, 1)), lengths


def _pieces(bags: Bags, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    for batch in batches:
        for piece in pieces(batch, 1, max(1, CELLS // max(1, len(bags.lengths))), BYTES):
            yield piece.column(0), [(t.as_py() or "").split() for t in piece.column(1)]


def _source(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def word_bound(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, common, doc_words, item_words, bound) over all words: no word similarity of the two is above ``bound``.

    ``common`` is the sum of the smaller counts, ``bound`` twice that over both lengths, 1 for two texts without a word.
    Pairs without a row have no word in common: their bound is 0. The items' words are held by every worker.
    """
    bags = Bags(items)
    names = ["doc_id", "item_id", "common", "doc_words", "item_words", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(bags, batches):
            common, bound, lengths = bags.bounds(texts)
            doc, item = np.nonzero(bound)
            columns = [ids.take(pa.array(doc)), bags.ids.take(pa.array(item)), *map(pa.array, (common[doc, item], lengths[doc], bags.lengths[item], bound[doc, item]))]
            yield pa.record_batch(columns, names=names)

    schema = StructType([docs.schema["doc_id"], items.schema["item_id"], *[StructField(c, LongType()) for c in names[2:5]], StructField("bound", DoubleType())])
    return _source(docs).mapInArrow(run, schema)


def best_similarity(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): each document against the item to whose words it comes nearest by ``word_bound``, the first of equals.

    Documents without a word in common with any item have no row.
    """
    bags = Bags(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(bags, batches) if len(bags.lengths) else ():
            bound = bags.bounds(texts)[1]
            best = bound.argmax(axis=1)
            doc = np.flatnonzero(bound.max(axis=1))
            ratios = [round(word_ratio(bags.words[k], texts[i]), 4) for i, k in zip(doc.tolist(), best[doc].tolist())]
            yield pa.record_batch([ids.take(pa.array(doc)), bags.ids.take(pa.array(best[doc])), pa.array(ratios, pa.float64())], names=["doc_id", "item_id", "similarity"])

    return _source(docs).mapInArrow(run, StructType([docs.schema["doc_id"], items.schema["item_id"], StructField("similarity", DoubleType())]))
