"""Converters of single files: bytes to (text, label). A chain is one function, so that a later converter runs only if the earlier ones fail."""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.functions.text import LANGUAGES
from paperloom.sources.files import DEFAULT_EXTENSIONS

#: Limits of an archive: nested archives, members, bytes when unpacked.
DEPTH, MEMBERS, UNPACKED = 4, 10_000, 512 * 2**20
TIMEOUT_S = 120


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.links, self.rows, self.cell, self.lists = 0, [], None, None, []

    def say(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in ("script", "style", "head", "title"):
            self.hidden += 1
        elif tag in ("b", "strong"):
            self.say("**")
        elif tag in ("i", "em"):
            self.say("_")
        elif tag == "code":
            self.say("`")
        elif tag == "br":
            self.say("  \n")
        elif tag == "hr":
            self.say("\n\n* * *\n\n")
        elif re.fullmatch("h[1-6]", tag):
            self.say("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "ul", "ol", "blockquote", "pre"):
            self.lists += [tag] if tag in ("ul", "ol") else []
            self.say("\n\n")
        elif tag == "li":
            self.say("\n  * " if self.lists[-1:] != ["ol"] else "\n  1. ")
        elif tag == "a":
            self.links.append(at.get("href") or "")
            self.say("[")
        elif tag == "img":
            self.say(f"![{at.get('alt') or ''}]({at.get('src') or ''})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.rows = self.rows or [[]]
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("b", "strong"):
            self.say("**")
        elif tag in ("i", "em"):
            self.say("_")
        elif tag == "code":
            self.say("`")
        elif re.fullmatch("h[1-6]|p|div|blockquote|pre", tag):
            self.say("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.say("\n\n")
        elif tag == "a" and self.links:
            self.say(f"]({self.links.pop()})")
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            self.say("\n\n" + pipe_table(rows) + "\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.say(re.sub(r"\s+", " ", data))


def pipe_table(rows: list[list[str | None]]) -> str:
    if not rows or not rows[0]:
        return ""
    width = max(map(len, rows))
    cells = [[(c or "").strip().replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n(?<!  \n)", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_tables_to_markdown(text: str) -> str:
    """Only the table blocks, with a div, html or body right around one."""
    block = re.compile(r"(?:<(?:html|body|div)[^>]*>\s*)*<table[^>]*>.*?</table>(?:\s*</(?:html|body|div)>)*", re.S)
    return block.sub(lambda m: html_to_markdown(m[0]), text)


def rtf_to_text(data: bytes) -> str | None:
    """Text of an RTF document, with or without its prologue; None for other bytes."""
    source = data.decode("latin-1")
    if not source.lstrip().startswith("{"):
        return None
    skip = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "datastore"}
    says = {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "page": "\n"}
    out, stack, hidden, after, left = [], [], False, 1, 0
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", source, re.S):
        word, number, code, sign, brace, text = m.groups()
        if brace == "{":
            stack.append((hidden, after))
        elif brace == "}":
            hidden, after = stack.pop() if stack else (False, 1)
        elif word:
            if word in skip:
                hidden = True
            elif word == "uc":
                after = int(number or 1)
            elif word == "u" and not hidden:
                out.append(chr(int(number or 63) % 65536))
                left = after
            elif not hidden:
                out.append(says.get(word, ""))
        elif sign == "*":
            hidden = True
        elif code or sign or text:
            piece = bytes([int(code, 16)]).decode("cp1252", "replace") if code else {"~": "\xa0", "-": "", "_": "-"}.get(sign, sign) if sign else text
            piece, left = piece[left:], max(0, left - len(piece))
            out.append("" if hidden else piece)
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text.strip() or None


def docx_to_text(data: bytes) -> str | None:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    says = {w + "tab": "\t", w + "br": "\n", w + "cr": "\n"}
    lines = ["".join(x.text or "" if x.tag == w + "t" else says.get(x.tag, "") for x in p.iter()) for p in root.iter(w + "p")]
    return "\n\n".join(lines).strip() or None


def epub_to_text(data: bytes) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        with_spine = [n for n in z.namelist() if n.endswith(".opf")]
        if with_spine:
            opf = ElementTree.fromstring(z.read(with_spine[0]))
            ns, base = "{http://www.idpf.org/2007/opf}", os.path.dirname(with_spine[0])
            items = {i.get("id"): os.path.normpath(os.path.join(base, i.get("href") or "")) for i in opf.iter(ns + "item")}
            pages = [p for p in (items.get(i.get("idref")) for i in opf.iter(ns + "itemref")) if p in z.namelist()] or pages
        return "\n\n".join(html_to_markdown(z.read(p).decode("utf-8", "replace")) for p in pages).strip() or None


def pdf_to_text(data: bytes) -> str | None:
    """Text shown by simple fonts in plain or deflated streams."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            line = []
            for s, array, move in re.findall(rb"(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(T\*|\bT[dD]\b)", block, re.S):
                shown = [s] if s else re.findall(rb"\((?:\\.|[^\\()])*\)", array)
                line.append("\n" if move else b"".join(re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(x[1], x[1]), x[1:-1], flags=re.S) for x in shown).decode("cp1252", "replace"))
            out.append("".join(line).strip())
    return "\n".join(x for x in out if x) or None


def command(*argv: str, suffix: str, output: str | None = None) -> Callable[[bytes], str | None]:
    """A converter that calls a tool, if it is there; IN and OUT in ``argv`` stand for files of a folder of its own."""

    def convert(data: bytes) -> str | None:
        if not shutil.which(argv[0]):
            return None
        with tempfile.TemporaryDirectory() as folder:
            source, target = f"{folder}/in{suffix}", f"{folder}/{output or 'out.md'}"
            with open(source, "wb") as f:
                f.write(data)
            done = subprocess.run([{"IN": source, "OUT": target, "DIR": folder}.get(a, a) for a in argv], capture_output=True, timeout=TIMEOUT_S)
            if done.returncode:
                return None
            if os.path.exists(target):
                with open(target, encoding="utf-8", errors="replace") as f:
                    return f.read()
            return done.stdout.decode("utf-8", "replace")

    return convert


def _tables_too(convert: Callable[[bytes], str | None]) -> Callable[[bytes], str | None]:
    return lambda data: None if (x := convert(data)) is None else html_tables_to_markdown(x)


REGISTRY: dict[str, dict[str, Callable[[bytes], str | None]]] = {
    "pdf": {
        "mineru": _tables_too(command("mineru", "-p", "IN", "-o", "DIR", "-b", "pipeline", suffix=".pdf", output="in/auto/in.md")),
        "markitdown": command("markitdown", "IN", "-o", "OUT", suffix=".pdf"),
        "markitdown-uvx": command("uvx", "markitdown", "IN", "-o", "OUT", suffix=".pdf"),
        "pdftotext": command("pdftotext", "-layout", "IN", "OUT", suffix=".pdf"),
        "paddleocr": _tables_too(command("paddleocr", "pp_structurev3", "-i", "IN", "--save_path", "DIR", suffix=".pdf", output="in.md")),
        "builtin-pdf": pdf_to_text,
    },
    "docx": {"pandoc": command("pandoc", "-f", "docx", "-t", "markdown", "IN", "-o", "OUT", suffix=".docx"), "builtin-docx": docx_to_text},
    "rtf": {"pandoc": command("pandoc", "-f", "rtf", "-t", "markdown", "IN", "-o", "OUT", suffix=".rtf"), "unrtf": command("unrtf", "--text", "IN", suffix=".rtf"), "builtin-rtf": rtf_to_text},
    "epub": {"ebook-convert": command("ebook-convert", "IN", "OUT", suffix=".epub", output="out.txt"), "builtin-epub": epub_to_text},
    "doc": {"soffice": command("soffice", "--headless", "--convert-to", "txt:Text", "--outdir", "DIR", "IN", suffix=".doc", output="in.txt")},
}


# Names of Python converters whose part the built-in readers take.
ALIASES = {"pdfplumber": "builtin-pdf", "docx2txt": "builtin-docx", "striprtf": "builtin-rtf"}


def available() -> dict[str, list[str]]:
    tools = {"builtin", *filter(shutil.which, ("mineru", "markitdown", "pdftotext", "paddleocr", "pandoc", "unrtf", "ebook-convert", "soffice"))}
    if shutil.which("uvx"):
        tools.add("markitdown-uvx")
    return {fmt: [c for c in own if c in tools or c.startswith("builtin")] for fmt, own in REGISTRY.items()}


def plain(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def convert(name: str, data: bytes | None, config: dict[str, list[str]] | None = None, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, depth: int = 0) -> tuple[str, str]:
    """Text and label of one file. The first converter that gives a text wins, an empty one too; none: a failure text, label ``failed``."""
    ext = os.path.splitext(name.lower())[1]
    if data is None:
        return f"[Failed to read {os.path.basename(name)}]", "failed"
    if ext == ".zip":
        return unzip(name, data, config, extensions, depth)
    if ext == ".eml":
        from paperloom.operators.mail import compile_email

        return compile_email(name, data, None, config, extensions)
    fmt = ext[1:]
    if fmt not in REGISTRY:
        return plain(data), "direct_read"
    for tool in (config or {}).get(fmt) or REGISTRY[fmt]:
        try:
            if tool in REGISTRY[fmt] and (text := REGISTRY[fmt][tool](data)) is not None:
                return text, tool
        except Exception:  # the next one may do
            continue
    return f"[Failed to convert {fmt.upper()} file: {os.path.basename(name)}]", "failed"


def fenced(name: str, text: str, ticks: str = "```") -> str:
    return f"{ticks}{LANGUAGES.get(os.path.splitext(name.lower())[1], '')}\n{text}\n{ticks}\n\n"


def members(data: bytes) -> list[tuple[str, bytes]]:
    """Files of an archive by name, within the limits; absolute names and ways out of it are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("/") and ".." not in i.filename.split("/")]
        if len(infos) > MEMBERS or sum(i.file_size for i in infos) > UNPACKED:
            raise ValueError("the archive is over the limits")
        return sorted((i.filename, z.read(i)) for i in infos)


def unzip(name: str, data: bytes, config=None, extensions=DEFAULT_EXTENSIONS, depth: int = 0) -> tuple[str, str]:
    """A report on an archive: all members by name, then those with a wanted suffix."""
    base = os.path.basename(name)
    try:
        if depth >= DEPTH:
            raise ValueError("archives are nested too deep")
        found = members(data)
    except zipfile.BadZipFile:
        return f"[Error: {base} is not a valid ZIP file]", "failed-bad_zip"
    except Exception as e:
        return f"[Error processing ZIP file: {e}]", "failed-exception"
    out, labels = f"# ZIP Archive Contents: {base}\n\n## Files in archive:\n\n" + "".join(f"- {n}\n" for n, _ in found) + "\n## Extracted file contents:\n\n", set()
    for n, content in found:
        if os.path.splitext(n.lower())[1] in extensions:
            text, label = convert(n, content, config, extensions, depth + 1)
            labels.add(label)
            out += f"### File: {n}\n\n" + fenced(n, text)
    return out, "zip_extract+" + "+".join(sorted(labels))


def converted(files: DataFrame, config: dict[str, list[str]] | None = None, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """rel_path, ext, text, method, ok for each file of ``with_content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rel, name, ext, content = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rel_path", "name", "ext", "content"))
            done = [convert(n, c, config, extensions) for n, c in zip(name, content)]
            yield pa.record_batch([pa.array(rel, pa.string()), pa.array(ext, pa.string()), pa.array([t for t, _ in done], pa.string()), pa.array([m for _, m in done], pa.string()), pa.array([not m.startswith("failed") for _, m in done])], names=["rel_path", "ext", "text", "method", "ok"])

    return files.mapInArrow(run, "rel_path string, ext string, text string, method string, ok boolean")
