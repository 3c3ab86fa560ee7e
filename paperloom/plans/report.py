"""A folder to one Markdown file: listing, filters, conversion, statistics, rendering."""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import __version__
from paperloom.functions.text import language
from paperloom.operators import converters, mail, relations
from paperloom.sources import files as sources


@dataclass
class Options:
    source: str
    output: str
    recursive: bool = False
    extensions: tuple[str, ...] = sources.DEFAULT_EXTENSIONS
    patterns: list[str] = field(default_factory=list)
    config: dict[str, list[str]] = field(default_factory=dict)
    standard: bool = False
    when: datetime.datetime | None = None


@dataclass
class Result:
    found: bool
    mode: str = "standard"
    stats: DataFrame | None = None
    suspicious: list[str] = field(default_factory=list)


def entries(converted: DataFrame) -> DataFrame:
    """(rel_path, entry): header and body of each file; archives, e-mails and PDFs are Markdown already."""
    header = F.concat(F.lit("## File: "), "rel_path", F.lit(" (converted with "), "method", F.lit(")\n"))
    body = F.when(F.col("ext").isin(".zip", ".eml", ".pdf"), F.col("text")).otherwise(F.concat(F.lit("````"), language(F.col("ext")), F.lit("\n"), "text", F.lit("\n````\n\n")))
    return converted.select("rel_path", F.concat(header, body).alias("entry"))


def _header(source: str, when: str, n: int) -> str:
    return (
        "This is a merged representation of the documents of a folder.\n\n# File Summary\n\n## Purpose\nOne file with the contents of all documents, for reading and automated processing.\n\n"
        "## File Format\n1. This summary\n2. Directory information\n3. Directory structure\n4. Files, each with its path and contents\n\n"
        "## Usage Guidelines\n- Change the original files, not this one.\n- Tell files apart by their paths.\n\n"
        "## Notes\n- Files may have been left out by suffix or pattern.\n- Archives and e-mails are unpacked.\n\n"
        f"# Directory Information\n- Source Directory: {source}\n- Compilation Date: {when}\n- Total Files Processed: {n}\n\n# Directory Structure\n```\n"
    )


def _folder_of(path: str) -> list[tuple[str, bytes]]:
    for spelling in relations.FOLDERS:
        folder = os.path.join(os.path.dirname(path), spelling)
        if os.path.isdir(folder):
            out = []
            for name in sorted(os.listdir(folder)):
                if os.path.isfile(p := os.path.join(folder, name)):
                    with open(p, "rb") as f:
                        out.append((name, f.read()))
            return out
    return []


def compile_folder(spark: SparkSession, o: Options) -> Result:
    """Writes the report; nothing is written if no file is left. The output itself is never among the sources."""
    when = (o.when or datetime.datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    source, output = os.path.abspath(o.source), os.path.abspath(o.output)
    listed = sources.listing(spark, source, o.recursive).where(F.col("path") != output)
    kept = relations.without(relations.wanted(listed, list(o.extensions)), o.patterns)
    head = kept.orderBy("path").limit(2).collect()
    if not head:
        return Result(False)
    mode = "standard" if o.standard or len(head) > 1 or head[0]["ext"] != ".eml" else "single_email"
    content = sources.with_content(kept)
    prefix = sources.decoded(F.col("content"))
    risky = [r.rel_path for r in relations.suspicious(content.where(F.col("ext").isin(*relations.SUSPICIOUS)).withColumn("text", prefix)).select("rel_path").orderBy("rel_path").collect()]
    if mode == "single_email":
        path = head[0]["path"]
        with open(path, "rb") as f:
            data = f.read()
        folder = _folder_of(path)
        text, method = mail.compile_email(path, data, folder, o.config, o.extensions, when)
        with open(output, "w", encoding="utf-8") as f:
            f.write(mail.analysis(data, text, folder, when, __version__))
        rows = spark.createDataFrame([(head[0]["rel_path"], ".eml", text, method, True)], "rel_path string, ext string, text string, method string, ok boolean")
        return Result(True, mode, relations.file_stats(rows), risky)
    done = converters.converted(content, o.config, o.extensions).persist()
    with open(output, "w", encoding="utf-8") as f:
        f.write(_header(source, when, done.count()))
        root = os.path.dirname(source) if os.path.isfile(source) else source
        around = kept if root == source else relations.without(relations.wanted(sources.listing(spark, root, o.recursive), list(o.extensions)), o.patterns)
        for row in relations.directory_tree(around).orderBy("sort_key", "kind", "rel_path").toLocalIterator():
            f.write(row.line + "\n")
        f.write("```\n\n# Files\n\n")
        for row in entries(done).orderBy("rel_path").toLocalIterator():
            f.write(row.entry)
    return Result(True, mode, relations.file_stats(done), risky)
