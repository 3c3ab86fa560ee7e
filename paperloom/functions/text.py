"""Scalar functions on columns; all run inside Spark but ``word_similarity``."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# White space as Unicode has it, as the body of a Java character class.
WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Fence labels by suffix, and converter formats by suffix.
LANGUAGES = {
    ".py": "python", ".rb": "ruby", ".js": "javascript", ".html": "html", ".css": "css", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".md": "markdown", ".txt": "text",
    ".sh": "bash", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".php": "php", ".sql": "sql", ".xml": "xml", ".go": "go", ".rs": "rust",
    ".ts": "typescript", ".swift": "swift", ".kt": "kotlin", ".dart": "dart", ".pl": "perl", ".r": "r", ".lua": "lua", ".scala": "scala", ".cs": "csharp", ".vb": "vb",
}
FORMATS = {".pdf": "pdf", ".docx": "docx", ".rtf": "rtf", ".doc": "doc"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extension(name: Column) -> Column:
    """Last suffix of a base name, lower-cased, dot included; leading dots don't begin one."""
    return F.regexp_extract(F.lower(name), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(ext: Column) -> Column:
    return F.coalesce(lookup(LANGUAGES, ext), F.lit(""))


def converter_format(ext: Column) -> Column:
    return lookup(FORMATS, F.lower(ext))


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def token_count(text: Column) -> Column:
    """Words between Unicode white space, and one more where the text ends a sentence."""
    return (F.regexp_count(text, F.lit(f"[^{WS}]+")) + F.when(text.rlike(rf"[.!?][{WS}]*\z"), 1).otherwise(0)).cast("long")


# Units of sizes, each 1024 of the one before.
UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(size: Column) -> Column:
    """Bytes to one decimal, ties to even, in the first unit that leaves less than 1024, else the last."""
    last = len(UNITS) - 1
    out = F.format_string(f"%.1f {UNITS[last]}", F.bround(size / float(1024**last), 1))
    for power, unit in reversed([*enumerate(UNITS[:last])]):
        out = F.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def markdown_table(rows: Column) -> Column:
    """A pipe table from array<array<string>>: ragged rows padded, null cells empty; no rows or an empty first one give an empty string."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.regexp_replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), "\n", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")
    return F.when((F.size(rows) > 0) & (F.size(F.get(rows, 0)) > 0), whole).otherwise("")


def cell_density(rows: Column) -> Column:
    """Share of cells that aren't blank; 0 without cells."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.coalesce(strip(c), F.lit("")) != ""))
    return F.when(F.coalesce(F.size(cells), F.lit(0)) <= 0, 0.0).otherwise(filled / F.greatest(F.size(cells), F.lit(1)))


def auth_result(auth: Column, scheme: str) -> Column:
    """Pass before Fail; null if the header says neither."""
    return F.when(auth.contains(f"{scheme}=pass"), "Pass").when(auth.contains(f"{scheme}=fail"), "Fail")


def email_label(source: Column) -> Column:
    return F.concat(F.lit("email+"), F.replace(F.lower(source), F.lit(" "), F.lit("_")))


def word_ratio(a: list[str], b: list[str]) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, looking only at the places in ``b`` of words that ``a`` has; both empty 1, one empty 0."""
    if not a or not b:
        return float(not a and not b)
    places: dict[str, list[int]] = {w: [] for w in a}
    for j, w in enumerate(b):
        if w in places:
            places[w].append(j)
    if len(b) >= 200:  # words that are frequent in a long text don't begin a match there, but may lengthen one
        places = {w: js for w, js in places.items() if len(js) <= len(b) // 100 + 1}
    found = [places.get(w, ()) for w in a]
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        i, j, size, ends = a_from, b_from, 0, {}
        for k in range(a_from, a_to):
            js, now = found[k], {}
            for at in js[bisect_left(js, b_from) : bisect_left(js, b_to)] if js else ():
                n = now[at] = ends.get(at - 1, 0) + 1
                if n > size:
                    i, j, size = k - n + 1, at - n + 1, n
            ends = now
        while i > a_from and j > b_from and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_to and j + size < b_to and a[i + size] == b[j + size]:
            size += 1
        if size:
            matched += size
            if a_from < i and b_from < j:
                todo.append((a_from, i, b_from, j))
            if i + size < a_to and j + size < b_to:
                todo.append((i + size, a_to, j + size, b_to))
    return 2.0 * matched / (len(a) + len(b))


def similarity(reference: str, candidate: str) -> float:
    """Ratcliff-Obershelp ratio of two word lists; both empty 1, one empty 0."""
    return word_ratio((reference or "").split(), (candidate or "").split())


@F.pandas_udf(DoubleType())
def word_similarity(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([round(similarity(a, b), 4) for a, b in zip(reference, candidate)])
