"""Order-preserving packing by dynamic programming (operator 3).

The documents of an input partition, in their order, are one stream of tokens. A window of at most ``width`` tokens
ends at a document's end, at a sentence's end, or, inside a stretch without either, at one of evenly spaced places.
With f(j) the least cost of windows that end at boundary j,

    f(j) = min over i with b(j) - b(i) <= width of f(i) + width - (b(j) - b(i)) + penalty(j)

and as width - b(j) + penalty(j) doesn't depend on i, the minimum of f(i) + b(i) over a sliding range is kept in a
monotone queue: one step for each boundary. The stream is settled in stretches; the last window of a stretch, not yet
full, goes on with the next. What is left at a partition's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_back, id_key
from paperloom.llm.tokens import REMEMBERED, encoder

VOCABULARY = "word_bpe_49k.json"
WIDTH, END_ID = 4096, 2
#: Costs in tokens of padding: to cut a document after a sentence, or elsewhere.
SENTENCE_COST, ELSEWHERE_COST = 4, 48
#: Without a better place, a window may end at multiples of this.
SPACING = 256
#: Tokens of a stretch.
STRETCH = 64 * WIDTH

SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long, ids binary"


def sentence_ends(vocabulary: str) -> np.ndarray:
    """For each id whether it ends a sentence."""
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith((".</w>", "!</w>", "?</w>"))]] = True
    return ends


def boundaries(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in (0, len(ids)] where a window may end, and what each costs; the document's own end costs nothing."""
    n = len(ids)
    natural = np.flatnonzero(ends[ids[:-1]]) + 1
    at = np.concatenate(([0], natural, [n]))
    wide = np.flatnonzero(at[1:] - at[:-1] > SPACING)
    if not len(wide):
        cost = np.full(len(at) - 1, SENTENCE_COST)
        cost[-1] = 0
        return at[1:], cost
    forced = [np.arange(at[k] + SPACING, at[k + 1], SPACING) for k in wide]
    places = np.concatenate([natural, [n], *forced])
    cost = np.concatenate([np.full(len(natural), SENTENCE_COST), [0], *[np.full(len(x), ELSEWHERE_COST) for x in forced]])
    places, first = np.unique(places, return_index=True)
    cost = cost[first]
    cost[-1] = 0
    return places, cost


def best_cuts(places: list[int], costs: list[int], width: int, final: bool) -> list[int]:
    """Ends of the windows from 0 over ascending ``places``, gaps at most ``width``.

    Not ``final``: the cuts of the cheapest way to any place within ``width`` of the last, so that less than a window stays open.
    """
    b, f, back = [0, *places], [0.0], [0]
    queue: deque[int] = deque([0])
    for j in range(1, len(b)):
        while b[j] - b[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        f.append(f[i] + width - (b[j] - b[i]) + costs[j - 1])
        back.append(i)
        value = f[j] + b[j]
        while queue and f[queue[-1]] + b[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    j = len(b) - 1
    if not final:
        j = min((k for k in range(len(b)) if b[-1] - b[k] < width), key=lambda k: f[k])
    out = []
    while j:
        out.append(b[j])
        j = back[j]
    return out[::-1]


def tail_cuts(n: int) -> list[int]:
    """Ends of pieces of ``n`` tokens at powers of two, the largest first."""
    out, at = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            at += 1 << k
            out.append(at)
    return out


def padding(n: int, width: int = WIDTH) -> int:
    return 0 if n & (n - 1) == 0 else width - n


class Packer:
    """Takes documents in order and gives the pieces of settled windows."""

    def __init__(self, ends: np.ndarray, width: int, first_sequence: int):
        self.ends, self.width, self.sequence = ends, width, first_sequence
        self.open: list[tuple[int, np.ndarray, int, np.ndarray, np.ndarray]] = []  # id, ids, tokens already settled, places, costs
        self.tokens = 0

    def add(self, doc: int, ids: np.ndarray) -> list[tuple]:
        self.open.append((doc, ids, 0, *boundaries(ids, self.ends)))
        self.tokens += len(ids)
        return self.settle(False) if self.tokens >= STRETCH else []

    def settle(self, final: bool) -> list[tuple]:
        places, costs, base = [], [], 0
        for _, ids, done, at, cost in self.open:
            live = at > done
            places.append(at[live] - done + base)
            costs.append(cost[live])
            base += len(ids) - done
        if not base:
            return []
        cuts = best_cuts(np.concatenate(places).tolist(), np.concatenate(costs).tolist(), self.width, False)
        if final:
            last = cuts[-1] if cuts else 0
            cuts += [last + x for x in tail_cuts(base - last)]
        return self._take(cuts)

    def _take(self, cuts: list[int]) -> list[tuple]:
        out, last = [], 0
        for end in cuts:
            need, offset, pad = end - last, 0, padding(end - last, self.width)
            while need:
                doc, ids, done, at, cost = self.open[0]
                n = min(need, len(ids) - done)
                part = np.ascontiguousarray(ids[done : done + n], "<u4").tobytes()
                out.append((doc, done, n, zlib.crc32(part), len(ids), self.sequence, offset, pad, part))
                need, offset = need - n, offset + n
                if done + n == len(ids):
                    self.open.pop(0)
                else:
                    self.open[0] = (doc, ids, done + n, at, cost)
            self.sequence += 1
            last = end
        self.tokens -= last
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remember: int = REMEMBERED) -> DataFrame:
    """One row for each piece of a document in a sequence.

    doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset (in the
    sequence), padding (of the sequence), ids (little-endian 32-bit). Each id lies in one piece; pieces of a sequence
    follow each other without a gap. The order is that of the input; nothing is shuffled and a task holds one stretch
    of tokens and one document. Null and empty texts are documents of the end id alone; null ids stay null; repeated
    rows are packed each; an empty table gives no rows; other columns are not looked at. ``remember``: pieces of text
    whose ids a worker keeps, some 200 bytes each; results don't depend on it.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(sentence_ends(path), width, (context.partitionId() if context else 0) << 36)
        encode = encoder(path, "word", remember).encode

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 9, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    found += packer.add(doc, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                yield rows(found)
        yield rows(packer.settle(True))

    source = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA).withColumn("id", id_back("id")).withColumnRenamed("id", "doc_id")


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
