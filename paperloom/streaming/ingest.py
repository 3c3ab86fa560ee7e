"""File statistics kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions.text import base_name, char_count, extension, token_count
from paperloom.sources.files import DEFAULT_EXTENSIONS, decoded


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS) -> StreamingQuery:
    """Appends path, chars and tokens of each new text file to Parquet and stops when all are taken; restarts go on where it ended."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    new = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    text = new.where(extension(base_name(F.col("path"))).isin(*extensions)).select("path", decoded(F.col("content")).alias("text"))
    stats = text.select("path", char_count(F.col("text")).alias("chars"), token_count(F.col("text")).alias("tokens"))
    return stats.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
