"""Command line: compile a folder, or ``benchmark`` converters."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from paperloom import __version__
from paperloom.operators import converters, relations
from paperloom.plans import benchmark, report
from paperloom.sources.files import DEFAULT_EXTENSIONS


def suffixes(text: str) -> tuple[str, ...]:
    return tuple("." + x.strip().lower() for x in text.split(",") if x.strip())


def converter_list(fmt: str, text: str | None) -> list[str]:
    names = [converters.ALIASES.get(x, x) for x in (x.strip() for x in (text or "").split(",")) if x]
    unknown = [x for x in names if x not in converters.REGISTRY[fmt]]
    if unknown:
        print(f"Unknown {fmt} converter: {', '.join(unknown)}; there are {', '.join(converters.REGISTRY[fmt])}", file=sys.stderr)
        raise SystemExit(1)
    return names


def converter_info() -> str:
    have = converters.available()
    return "\n".join(f"{fmt}: active {', '.join(have[fmt]) or 'none'}; missing {', '.join(c for c in own if c not in have[fmt]) or 'none'}" for fmt, own in converters.REGISTRY.items())


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["benchmark"]:
        p = argparse.ArgumentParser(prog="paperloom benchmark")
        p.add_argument("files", nargs="*")
        p.add_argument("--runs", type=int, default=3)
        p.add_argument("--output-dir", default="benchmark")
        p.add_argument("--formats", default="all")
        a = p.parse_args(argv[1:])
        _, order = benchmark.run_benchmark(SparkSession.builder.getOrCreate(), a.files, a.output_dir, a.runs, benchmark.chosen(a.formats))
        with open(f"{a.output_dir}/results.json", encoding="utf-8") as f:
            found = json.load(f)
        print(benchmark.table(found["results"], found["failed"]))
        print("\n".join(f"{fmt}: {', '.join(own)}" for fmt, own in sorted(order.items())))
        return 0
    p = argparse.ArgumentParser(prog="paperloom")
    p.add_argument("folder", nargs="?")
    p.add_argument("-o", "--output", default="paperloom-output.md")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-e", "--extensions", default="")
    p.add_argument("-x", "--exclude", default="")
    p.add_argument("-v", "--version", action="store_true")
    p.add_argument("--standard-format", action="store_true")
    for fmt in ("pdf", "docx", "rtf"):
        p.add_argument(f"--{fmt}-converters")
    a = p.parse_args(argv)
    if a.version:
        print(f"paperloom {__version__}\n{converter_info()}")
        return 0
    if not a.folder:
        p.print_help()
        return 0
    config = {fmt: names for fmt in ("pdf", "docx", "rtf") if (names := converter_list(fmt, getattr(a, f"{fmt}_converters")))}
    patterns = [x.strip() for x in a.exclude.split(",") if x.strip()]
    for bad in relations.valid_patterns(patterns)[1]:
        print(f"Not a regular expression, left out: {bad}", file=sys.stderr)
    done = report.compile_folder(SparkSession.builder.getOrCreate(), report.Options(a.folder, a.output, a.recursive, suffixes(a.extensions) or DEFAULT_EXTENSIONS, patterns, config, a.standard_format))
    if not done.found:
        print("No files found.")
        return 0
    stats = done.stats.persist()
    for r in relations.top_files(stats).collect():
        print(f"{r.rank}. {r.path} ({r.chars:,} chars, {r.tokens:,} tokens)")
    t = relations.totals(stats).first()
    print(f"Suspicious: {', '.join(done.suspicious) or 'none'}\n{t.files:,} files, {t.chars:,} chars, {t.tokens:,} tokens: {a.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
