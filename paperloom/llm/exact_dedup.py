"""Exact dedup by content-defined chunk recipes (operator 4).

A text is cut where a rolling hash over its last 32 bytes hits a pattern, so equal passages give equal chunks wherever
they lie. Chunks become identifiers once their bytes have been compared, each distinct chunk of a task moving once; a
document then is the ordered list of its identifiers, 16 bytes for about a thousand, and documents are equal when
these lists are. Whole texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_back, id_key, written

WINDOW, LEAST, MASK, MOST = 32, 256, 0x3FF, 8192
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(b"  +")
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint32)
#: Distinct chunks that a task remembers so as not to send them again; then it forgets all and goes on.
REMEMBERED = 50_000


def normalised(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space as one space."""
    data = (text or "").encode("utf-8", "replace").translate(_SPACES)
    return _RUN.sub(b" ", data) if b"  " in data else data


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; they depend on its content only."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        rolled[width:] += rolled[:-width] << np.uint32(width)
        width *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((rolled >> np.uint32(20)) & np.uint32(MASK) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunk_id(chunk: bytes, salt: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16, salt=salt.to_bytes(16, "little")).digest()


def _chunks(data: bytes) -> Iterator[bytes]:
    last = 0
    for end in cuts(data):
        yield data[last:end]
        last = end


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def recipes(docs: DataFrame, salt: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, recipe binary: the chunks' 16-byte identifiers in order, text_sha256, n_bytes) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normalised(t.as_py()) for t in batch.column(1)]
            recipe = [b"".join(chunk_id(c, salt) for c in _chunks(d)) for d in data]
            yield pa.record_batch([batch.column(0), pa.array(recipe, pa.binary()), pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array(list(map(len, data)), pa.int64())], names=["id", "recipe", "text_sha256", "n_bytes"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, recipe binary, text_sha256 string, n_bytes long")


def chunks(docs: DataFrame, salt: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, content) of every chunk, those that a task has just met left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            ids, content = [], []
            for text in batch.column(1):
                for chunk in _chunks(normalised(text.as_py())):
                    if (key := chunk_id(chunk, salt)) not in known:
                        known.add(key)
                        ids.append(key)
                        content.append(chunk)
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(content, pa.binary())], names=["chunk", "content"])

    return _source(docs, id_col, text_col).mapInArrow(run, "chunk binary, content binary")


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``recipes`` under a salt for which every identifier has been seen to stand for one content only."""
    for salt in range(8):
        contents = chunks(docs, salt, id_col, text_col).repartition("chunk").groupBy("chunk", "content").agg(F.lit(1).alias("one"))
        if contents.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return recipes(docs, salt, id_col, text_col)
    raise RuntimeError("chunk identifiers collide under every salt")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, those to drop too.

    Texts are equal when they are after each run of ASCII white space has become one space; null counts as empty. The
    row with the smallest id stays, null ids coming first; of rows that repeat that id with that text one stays.
    Other columns are not looked at; an empty table gives an empty result.
    """
    listed = written(verified_recipes(docs, id_col, text_col), "recipes")
    groups = written(listed.groupBy("recipe").agg(F.min("id").alias("keep"), F.count("*").alias("group_size")), "groups")
    rows = listed.groupBy("recipe", "id", "text_sha256").agg(F.count("*").alias("same")).withColumnRenamed("recipe", "r")
    rows = written(rows, "rows")
    joined = rows.join(groups, rows["r"] == groups["recipe"]).select("id", "keep", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "same")).alias("k"))
    kept = (F.col("id") == F.col("keep")) & (F.col("k") == 1)
    return joined.select(id_back("id").alias("doc_id"), id_back("keep").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def op4(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size,
       n.doc_id = g.keep_id AND row_number() OVER (PARTITION BY n.t, n.doc_id) = 1 AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
