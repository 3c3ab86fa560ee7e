"""Filters, classifications and aggregates over the file relation."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import char_count, token_count

# The security check.
SUSPICIOUS = (".exe", ".bat", ".sh", ".com", ".vbs", ".ps1", ".py", ".rb")
LARGE, PREFIX = 1024 * 1024, 4096
# The folder of an e-mail's attachments, in order.
FOLDERS = ("attachments", "Attachments", "attachment", "Attachment")
RISKY = r"exec|eval|system|subprocess|os\."
#: Java's regular expressions mean the same as Python's for patterns of these parts.
_SHARED = re.compile(r"(?:[\w\s\-_/,:;@=<>~!%&']|\\[.\\dDsSwWbB/\-()\[\]{}+*?^$|]|[.*+?^$|()\[\]]|\{\d+(?:,\d*)?\})*")


def wanted(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.where(F.col("ext").isin([e.lower() for e in extensions]))


def valid_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Those that compile, and those that don't."""
    good, bad = [], []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            bad.append(p)
    return good, bad


def excluded(name: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in the base name; those only Python reads alike go to an Arrow function."""
    java = [p for p in patterns if _SHARED.fullmatch(p)]
    rest = [p for p in patterns if p not in java]
    out = F.lit(False)
    for p in java:
        out = out | name.rlike(p)
    if rest:

        @F.pandas_udf("boolean")
        def found(names: pd.Series) -> pd.Series:
            compiled = [re.compile(p) for p in rest]
            return names.map(lambda n: any(c.search(n) for c in compiled))

        out = out | found(name)
    return out


def without(files: DataFrame, patterns: list[str]) -> DataFrame:
    good, _ = valid_patterns(patterns)
    return files.where(~excluded(F.col("name"), good)) if good else files


def suspicious(files: DataFrame, text: str = "text") -> DataFrame:
    """Files of a risky kind that are large or whose first characters look like running something."""
    risky = F.when(F.col("size") > LARGE, True).otherwise(F.coalesce(F.substring(text, 1, PREFIX).rlike(RISKY), F.lit(False)))
    return files.where(F.col("ext").isin(*SUSPICIOUS)).where(risky)


def processing_mode(files: DataFrame, by: list[str] = (), forced: str | None = None) -> DataFrame:
    """``single_email`` if there is one file and it is an e-mail, else ``standard``; for each group of ``by``."""
    single = (F.count("*") == 1) & (F.max("ext") == ".eml")
    mode = F.lit(forced) if forced else F.when(single, "single_email").otherwise("standard")
    return files.groupBy(*by).agg(mode.alias("mode"))


def file_stats(converted: DataFrame) -> DataFrame:
    return converted.select(F.col("rel_path").alias("path"), char_count(F.col("text")).alias("chars"), token_count(F.col("text")).alias("tokens"), F.col("method").alias("conversion_method"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def top_files(stats: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest by characters, ties by path, with their rank; the window ranks ``n`` rows only."""
    top = stats.orderBy(F.desc("chars"), "path").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("chars"), "path")).alias("rank"), "*")


def directory_tree(files: DataFrame) -> DataFrame:
    """(sort_key, kind, rel_path, line): a top-down walk, a directory's own files before those below; hidden directories are left out."""
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    shown = files.select("dir", "rel_path", parts.alias("sort_key")).where(~F.exists("sort_key", lambda p: p.startswith(".")))
    lines = shown.select("sort_key", F.lit(1).alias("kind"), "rel_path", F.concat(F.lit("  "), "rel_path").alias("line"))
    above = shown.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("sort_key"), F.lit(1))), lambda k: F.slice("sort_key", 1, k))).alias("sort_key")).where(F.size("sort_key") > 0).distinct()
    dirs = above.select("sort_key", F.lit(0).alias("kind"), F.array_join("sort_key", "/").alias("rel_path"), F.concat(F.array_join("sort_key", "/"), F.lit("/")).alias("line"))
    return dirs.union(lines)


def attachment_folder(emails: DataFrame, files: DataFrame) -> DataFrame:
    """``emails`` with ``folder``: of the four spellings beside each e-mail the first that exists, null without one."""
    found = files.select("dir").distinct().withColumn("leaf", F.substring_index("dir", "/", -1)).where(F.col("leaf").isin(*FOLDERS))
    found = found.select(F.when(F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", "")).otherwise("").alias("parent"), "dir", F.array_position(F.array(*map(F.lit, FOLDERS)), F.col("leaf")).alias("priority"))
    best = found.groupBy("parent").agg(F.min_by("dir", "priority").alias("folder"))
    return emails.join(best, emails["dir"] == best["parent"], "left").drop("parent")


def first_success(candidates: DataFrame) -> DataFrame:
    """From (file, converter, priority, text) each file's first converter that gave a text, empty ones too."""
    return candidates.where("text is not null").groupBy("file").agg(F.min_by("converter", "priority").alias("method"), F.min_by("text", "priority").alias("text"))


def ordered_text(rows: DataFrame, by: str, order: str, text: str, separator: str = "") -> DataFrame:
    """One text for each group, its parts in order; for groups known to be small (an e-mail, an archive)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("s"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["s"]), separator).alias(text))


def ordered_digest(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, md5) of each group's texts end to end in order. Groups may be of any size: they are sorted by Spark and go through the digest a row at a time."""

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for k, part in zip(batch[by], batch[text]):
                if digest is None or k != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.md5()
                digest.update((part or "").encode())
            yield pd.DataFrame(out, columns=[by, "md5"])
        if digest is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=[by, "md5"])

    dealt = rows.select(by, order, text).repartition(by).sortWithinPartitions(by, order).select(by, text)
    return dealt.mapInPandas(run, f"{by} {dict(rows.dtypes)[by]}, md5 string")
