"""Rows through Python in little memory: what a worker holds at a time is bounded in rows and bytes, however large the table is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What goes to a Python worker at a time, and back, but for a row that is larger itself.
ROWS, BYTES = 2000, 2 * 2**20


def small_batches(spark: SparkSession) -> None:
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def pieces(batch: pa.RecordBatch, sized: int, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``rows`` rows and ``most`` bytes in column ``sized``, one row at least."""
    begin = held = 0
    for k in range(batch.num_rows):
        n = len(batch.column(sized)[k].as_buffer() or b"")
        if k > begin and (k - begin >= rows or held + n > most):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """``fn`` of the columns' values, row by row; its results go out as soon as they are large enough."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                out.append(fn(*[c[k].as_py() for c in batch.columns]))
                held += sum(len(x) for x in out[-1] if isinstance(x, str))
                if len(out) >= ROWS or held >= BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                    out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return df.mapInArrow(run, schema)
