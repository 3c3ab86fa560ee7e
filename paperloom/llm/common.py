"""What the operators of this subpackage share: the folder all executors see, tables written there, column safety."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import sys
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators, so that it joins and sorts (first) like any other id.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a local session (as in tests) gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    _forget_at_exit(spark, folder)
    return folder


def _forget_at_exit(spark: SparkSession, folder: str) -> None:
    def forget() -> None:
        try:
            delete(spark, folder)
        except Exception:  # the JVM may have ended before
            pass

    atexit.register(forget)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/paperloom-{what}-{uuid.uuid4().hex}"


#: Hashes and numbers hardly repeat: dictionaries would double the time of writing and give larger files.
TABLE = {"parquet.enable.dictionary": "false", "compression": "lz4_raw"}


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage, outlives lost executors, and gives AQE real sizes."""
    folder = new_folder(df.sparkSession, what)
    df.write.options(**TABLE).parquet(folder)
    collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Seconds between two collections on the driver.
COLLECTED_EVERY = 10
_collected = [0.0]


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver forget plans, broadcasts and task results of what is done, now and then; Spark drops shuffle files and broadcasts only when these are collected."""
    if time.monotonic() - _collected[0] >= COLLECTED_EVERY:
        give_back()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def id_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_key(text: Column) -> Column:
    """A hash that with the id tells rows apart that repeat an id; null counts as a text of its own."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def free_names(columns: list[str], n: int) -> list[str]:
    """``n`` column names that differ from all of ``columns``, whatever their case."""
    used, out, k = {c.lower() for c in columns}, [], 0
    while len(out) < n:
        if f"_x{k}" not in used:
            out.append(f"_x{k}")
        k += 1
    return out


#: Parts into which a group of equal rows is dealt.
SALTS = 64


def first_of_equals(rows: DataFrame, keys: list[str], again: str) -> DataFrame:
    """``rows`` with a column ``again``, true for all but one of the rows that are equal in ``keys``.

    Only rows of keys that repeat are dealt out, and these first in parts; which of equal rows is the one is left open.
    Where the first of ``keys`` never repeats nothing else is read.
    """
    repeated = lambda df, *by: written(df.groupBy(*by).agg(F.count("*").alias(again)).where(F.col(again) > 1).select(*by), "equal")
    often = repeated(rows, keys[0])
    if not often.isEmpty():
        often = repeated(rows.select(*keys).join(often, keys[0], "left_semi"), *keys)
    if often.isEmpty():
        return rows.withColumn(again, F.lit(False))
    salt, turn = free_names([*rows.columns, again], 2)
    once = rows.join(often, keys, "left_anti").withColumn(again, F.lit(False))
    part = rows.join(often, keys, "left_semi").withColumn(salt, F.monotonically_increasing_id() % SALTS)
    part = part.withColumn(turn, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(salt)))
    others = part.where(F.col(turn) > 1).drop(salt, turn).withColumn(again, F.lit(True))
    heads = part.where(F.col(turn) == 1).withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(salt)))
    return once.unionByName(others).unionByName(heads.withColumn(again, F.col(turn) > 1).drop(salt, turn))


def id_back(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NULL_ID), c)


_caches: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """Registers what a Python worker keeps from one task to the next."""
    _caches.append(cache)
    return cache


def give_back() -> None:
    """Memory of this Python process that isn't used any more goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_last: list[tuple[str, int]] = []
_tasks = itertools.count()


def release_caches() -> None:
    """Called where a task begins: workers serve one operator after another, and a new one finds no caches of those before.

    Memory is given back then and at every fourth task, as more often would cost more than it saves.
    """
    caller = sys._getframe(1).f_code
    if _last == [now := (caller.co_filename, caller.co_firstlineno)]:
        if next(_tasks) % 4:
            return
    else:
        _last[:] = [now]
        for cache in _caches:
            cache.clear()
    give_back()


#: Rows hold whole documents: so many at most go to a Python worker at a time.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents from which no label is learnt."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def connected_components(edges: DataFrame, least: str = "a", other: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Alternating star contraction: large stars link each larger neighbour of a node to the least one around it, small
    stars the smaller ones. Every round is written to the shared folder; only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(least, other).alias("u"), F.least(least, other).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
