"""Token ids in flat binary files with 64-bit document offsets, memory-mapped (operator 8).

A data set is a folder with, for each partition in ascending order of document ids, ``part-NNNNN.bin`` (unsigned
integers, 16 bits where the vocabulary fits, else 32, little-endian), ``part-NNNNN.idx`` (int64 offset of each document
in the part, and a last one for its end) and ``part-NNNNN.ids`` (int64 document ids); and ``manifest.json``, whose bases
are the prefix sums of the parts' tokens. Parts are written under another name and renamed, so that a task that is
run again after a lost executor replaces whole files.
"""

from __future__ import annotations

import json
import os
import uuid

from collections.abc import Iterator
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import id_back, id_key, new_folder
from paperloom.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids of the vocabulary files fit 16 bits up to here.
SHORT = 65536


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class _Part:
    """Writes one part a batch at a time."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.fs, base = _at(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.tag, self.dtype = f"{base}/{name}", uuid.uuid4().hex, dtype
        self.files = {x: self.fs.open_output_stream(f"{self.path}.{x}.{self.tag}") for x in ("bin", "idx", "ids")}
        self.tokens = self.docs = 0

    def add(self, docs: list[int], ids: list[bytes], end_id: int) -> None:
        tail = np.array([end_id], "<u4").tobytes()
        sizes = np.fromiter((len(x) // 4 + 1 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(y for x in ids for y in (x, tail)), "<u4")
        if self.dtype == "<u2" and len(flat) and flat.max() >= SHORT:
            raise ValueError("an id doesn't fit 16 bits")
        self.files["bin"].write(flat.astype(self.dtype).tobytes())
        self.files["idx"].write((self.tokens + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
        self.files["ids"].write(np.array(docs, "<i8").tobytes())
        self.tokens += int(sizes.sum())
        self.docs += len(docs)

    def close(self) -> None:
        self.files["idx"].write(np.array([self.tokens], "<i8").tobytes())
        for x, f in self.files.items():
            f.close()
            self.fs.move(f"{self.path}.{x}.{self.tag}", f"{self.path}.{x}")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> dict[str, Any]:
    """Encodes every whole text, appends ``end_id`` to each, writes the data set and returns its manifest.

    Documents lie in ascending order of their ids, null ids first and equal ids by their text; null and empty texts
    are the end id alone; an empty table gives a data set without parts; other columns are not looked at. ``folder``
    must be one that the driver and all executors share. Only one row for each part reaches the driver.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        part, encode = None, encoder(path, "byte").encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                part = part or _Part(folder, f"part-{number:05d}", dtype)
                part.add(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), end_id)
        if part:
            part.close()
            yield pa.record_batch([pa.array([number]), pa.array([part.docs]), pa.array([part.tokens])], names=["part", "docs", "tokens"])

    source = docs.select(id_key(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    parts = sorted(tuple(map(int, r)) for r in ordered.mapInArrow(run, "part long, docs long, tokens long").collect())
    base, listed = 0, []
    for number, n, tokens in parts:
        listed.append({"part": f"part-{number:05d}", "docs": n, "tokens": tokens, "base": base})
        base += tokens
    manifest = {"dtype": dtype, "end_id": end_id, "tokens": base, "parts": listed}
    files, at = _at(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict[str, Any]:
    files, at = _at(folder)
    with files.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def open_part(folder: str, part: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and document ids; memory-mapped where the folder is a mounted one."""
    files, at = _at(folder)
    if isinstance(files, pafs.LocalFileSystem):
        return tuple(np.memmap(f, kind, "r") if os.path.getsize(f) else np.zeros(0, kind) for f, kind in ((f"{at}/{part}.{x}", k) for x, k in (("bin", dtype), ("idx", "<i8"), ("ids", "<i8"))))
    return tuple(np.frombuffer(files.open_input_file(f"{at}/{part}.{x}").read(), k) for x, k in (("bin", dtype), ("idx", "<i8"), ("ids", "<i8")))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit) from a data set's files, a task for each part."""
    manifest = read_manifest(folder)
    dtype = manifest["dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = open_part(folder, row["part"], dtype)
                for at in range(0, len(docs), 1024):
                    own, cut = np.array(docs[at : at + 1024]), offsets[at : at + 1025].tolist()
                    content = [np.asarray(ids[a:b]).astype("<u4").tobytes() for a, b in zip(cut, cut[1:])]
                    yield pa.record_batch([pa.array(own), pa.array(np.array(cut[:-1]) + row["base"]), pa.array(np.diff(cut)), pa.array(content, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    parts = spark.createDataFrame([(p["part"], p["base"]) for p in manifest["parts"]], "part string, base long")
    parts = parts.repartition(max(1, len(manifest["parts"])), "part")
    return parts.mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumn("id", id_back("id")).withColumnRenamed("id", "doc_id")



def op8(docs: DataFrame) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder)
    return read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
