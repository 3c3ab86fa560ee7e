"""A training corpus from raw documents: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``, in their types and order.

In every stage null and empty texts are texts without a word, texts of any length are read whole, rows that repeat an id,
or have none, are documents of their own, other columns are passed through whatever their names, and an empty table gives
an empty one. Of rows equal in id and text one keeps its lines and stays; which, is left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from paperloom.llm.common import table, written


#: Jaccard similarity of the sets of five-word shingles, verified exactly.
NEAR = {"words": 5, "similarity": 0.8}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more go. Texts without a word have the bias for a score; equal texts score alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match one before them go; a row goes if that leaves it without a word, one that had none stays."""
    return line_dedup.drop_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id; all texts without a word are one group."""
    return simhash.keep_one(docs, **NEAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; an item of under five words matches nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens in pieces of sequences; a text without a word is its end id."""
    # the workers of a chain share their memory with the JVM of the stages before
    return packing.pack(docs, remember=150_000)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-duplicates", near_copies), ("decontamination", leaks), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds each stage against a version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
