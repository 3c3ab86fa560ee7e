"""Files as a relation: path, rel_path, dir, name, ext, size, content."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import base_name, extension

# The suffixes compiled by default.
DEFAULT_EXTENSIONS = (".pdf", ".epub", ".docx", ".doc", ".rtf", ".txt", ".md", ".py", ".rb", ".js", ".html", ".css", ".json", ".yml", ".yaml", ".zip", ".eml")
LISTED = "path string, rel_path string, dir string, name string, ext string, size long"
#: Larger files come without content.
MOST_BYTES = 512 * 2**20


def _walk(source: str, recursive: bool) -> Iterator[tuple[str, int]]:
    if os.path.isfile(source):
        yield source, os.path.getsize(source)
        return
    for root, dirs, names in os.walk(source):
        dirs.sort()
        for name in names:
            path = os.path.join(root, name)
            if os.path.isfile(path):
                yield path, os.path.getsize(path)
        if not recursive:
            return


def listing(spark: SparkSession, source: str, recursive: bool = True) -> DataFrame:
    """All files below a folder both driver and executors see, hidden ones too; a single file is a listing of one."""
    source = os.path.abspath(source)
    root = os.path.dirname(source) if os.path.isfile(source) else source
    rows = []
    for path, size in _walk(source, recursive):
        rel, name = os.path.relpath(path, root), os.path.basename(path)
        rows.append((path, rel, os.path.dirname(rel), name, os.path.splitext(name.lower())[1], size))
    return spark.createDataFrame(rows, LISTED)


def with_content(files: DataFrame) -> DataFrame:
    """Reads the files in the executors, a few rows at a time; null where one can't be read or is over the limit."""

    def read(path: str, size: int) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read() if size <= MOST_BYTES else None
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                content = [read(p, s) for p, s in zip(part.column(0).to_pylist(), part.column(5).to_pylist())]
                yield pa.record_batch([*part.columns, pa.array(content, pa.binary())], names=[*part.schema.names, "content"])

    # costs go by bytes, not by files: deal them out
    return files.repartition("path").mapInArrow(run, LISTED + ", content binary")


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same relation from any store Spark reads; names that begin with a dot or underscore are left out there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace("path", "^" + re.escape(folder.rstrip("/")) + "/?", "")
    return found.select("path", rel.alias("rel_path"), F.regexp_extract(rel, "^(.*)/", 1).alias("dir"), base_name(F.col("path")).alias("name"), extension(base_name(F.col("path"))).alias("ext"), F.col("length").alias("size"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 with malformed bytes replaced and universal line ends."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def corpus(docs: DataFrame) -> DataFrame:
    """The table ``documents`` as files: suffix by id, path by source."""
    k = (F.col("doc_id") % len(CORPUS_EXTENSIONS)).cast("int")
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.get(F.array(*map(F.lit, CORPUS_EXTENSIONS)), k))
    return docs.select("doc_id", F.concat("source", F.lit("/"), name).alias("rel_path"), F.col("source").alias("dir"), name.alias("name"), extension(name).alias("ext"), F.octet_length("text").cast("long").alias("size"), "text")


CORPUS_EXTENSIONS = (".txt", ".md", ".py", ".rb", ".json", ".html", ".zip", ".eml", ".pdf", ".xyz", ".SH")
