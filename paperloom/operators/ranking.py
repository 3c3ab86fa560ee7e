"""The converter benchmark: timings to accuracy, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import word_similarity

# Weights of speed and accuracy.
SPEED, ACCURACY = 0.4, 0.6


def run_stats(runs: DataFrame) -> DataFrame:
    """From (file, fmt, converter, priority, run, elapsed, text) one row for each file and converter, with its first text that isn't a failure."""
    good = F.col("text").isNotNull() & (F.length("text") > 0) & ~F.col("text").startswith("[Failed")
    return runs.groupBy("file", "fmt", "converter", "priority").agg(
        F.avg("elapsed").alias("mean"), F.min("elapsed").alias("min"), F.max("elapsed").alias("max"), F.count("*").alias("runs"), F.min_by(F.when(good, F.col("text")), F.when(good, F.col("run"))).alias("text")
    ).withColumn("success", F.col("text").isNotNull()).withColumn("output_length", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def with_accuracy(stats: DataFrame) -> DataFrame:
    """Word similarity to the file's longest text, ties going to the first converter."""
    best = stats.where("success").groupBy("file").agg(F.max_by("text", F.struct("output_length", -F.col("priority"))).alias("reference"))
    return stats.join(best, "file", "left").withColumn("accuracy", F.when(F.col("success"), word_similarity("reference", "text")).otherwise(F.lit(0.0))).drop("reference")


def scored(stats: DataFrame) -> DataFrame:
    """Combined score against the file's slowest success, and rank, ties by priority."""
    slowest = F.max("mean").over(Window.partitionBy("file"))
    speed = F.when(F.col("slowest") > 0, 1 - F.col("mean") / F.when(F.col("slowest") > 0, F.col("slowest"))).otherwise(1.0)
    out = stats.where("success").withColumn("slowest", slowest).withColumn("combined_score", SPEED * speed + ACCURACY * F.col("accuracy")).drop("slowest")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("combined_score"), "priority")))


def merged(ranked: DataFrame) -> DataFrame:
    """(fmt, ranking): converters in the order they first appear over the format's files."""
    first = ranked.groupBy("fmt", "converter").agg(F.min(F.struct("file", "rank")).alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "converter")))
    return first.groupBy("fmt").agg(F.transform(order, lambda x: x["converter"]).alias("ranking"))


def active_and_missing(configured: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = ["fmt", "converter"]
    return configured.join(available, key, "left_semi"), configured.join(available, key, "left_anti")
