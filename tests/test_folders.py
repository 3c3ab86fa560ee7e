import datetime
import hashlib
import io
import json
import os
import zipfile
from email.message import EmailMessage

import pytest

from paperloom import cli
from paperloom.operators import converters, mail, relations
from paperloom.plans import benchmark, report
from paperloom.sources import files
from paperloom.streaming import ingest

NOON = datetime.datetime(2024, 5, 6, 12, 0)


def archive(**members):
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return held.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for name, data in {
        "a.txt": b"Hello world.\r\nbye", "b/c.md": b"# c", "b/c/d.md": b"deep", ".x.txt": b"hidden", "_y.txt": b"under", ".git/z.txt": b"in hidden", "run.py": b"import os\nos.system('x')", "skip.bin": b"\0",
        "bad.zip": b"no zip", "good.zip": archive(in_DOT_txt=b"inner", sub__in_DOT_py=b"x = 1", no_DOT_bin=b"\1", nest_DOT_zip=archive(deep_DOT_txt=b"deepest")), "r.rtf": rb"{\rtf1\ansi Hello \b bold\b0\par caf\'e9 \u8364?}",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def digest(root):
    return {p: hashlib.md5(open(p, "rb").read()).hexdigest() for d, _, names in os.walk(root) for p in (os.path.join(d, n) for n in names)}


def test_folder(spark, tree):
    before, out = digest(tree), tree / "report.md"
    done = report.compile_folder(spark, report.Options(str(tree), str(out), True, when=NOON))
    text = out.read_text()
    again = report.compile_folder(spark, report.Options(str(tree), str(out), True, when=NOON))
    assert out.read_text() == text and again.found
    assert "# Directory Structure\n```\n  .x.txt\n  _y.txt\n  a.txt\n  bad.zip\n  good.zip\n  r.rtf\n  run.py\nb/\n  b/c.md\nb/c/\n  b/c/d.md\n```\n" in text
    assert "## File: a.txt (converted with direct_read)\n````text\nHello world.\nbye\n````\n\n" in text
    assert "## File: .git/z.txt (converted with direct_read)" in text and "## File: bad.zip (converted with failed-bad_zip)\n[Error: bad.zip is not a valid ZIP file]## File:" in text
    assert "(converted with zip_extract+direct_read+zip_extract+direct_read)" in text and "### File: deep.txt\n\n```text\ndeepest\n```" in text
    assert "Hello bold\ncafé €" in text and "skip.bin" not in text
    stats = {r.path: r for r in done.stats.collect()}
    assert len(stats) == 10 and (stats["a.txt"].chars, stats["a.txt"].tokens) == (16, 3)
    assert done.suspicious == ["run.py"] and [r["rank"] for r in relations.top_files(done.stats).collect()] == [1, 2, 3, 4, 5]
    out.unlink()
    assert digest(tree) == before
    flat = report.compile_folder(spark, report.Options(str(tree), str(out), False, (".txt", ".md"), ["^_"], when=NOON))
    assert sorted(r.path for r in flat.stats.collect()) == [".x.txt", "a.txt"]
    assert not report.compile_folder(spark, report.Options(str(tree), str(tree / "none.md"), extensions=(".zzz",))).found


def test_conversion_does_not_hang_on_partitions(spark, tree):
    listed = files.listing(spark, str(tree))
    results = [sorted((r.rel_path, r.text) for r in converters.converted(files.with_content(listed.repartition(n))).collect()) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]
    assert files.binary_files(spark, f"file://{tree}").count() < listed.count()


def message(html=True):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "a@x.org", "b@x.org", "Résumé", "Mon, 6 May 2024 12:00:00 +0000", "<1@x>"
    m["Authentication-Results"] = "x; spf=pass spf=fail dkim=fail"
    m.set_content("plain body")
    if html:
        m.add_alternative("<p>Hello <b>bold</b></p>", subtype="html")
    m.add_attachment(b"note text", maintype="text", subtype="plain", filename="../note.txt")
    m.add_attachment(b"\0", maintype="application", subtype="x", filename="x.bin")
    return m.as_bytes()


def test_mail(spark, tmp_path):
    m = mail.parse(message())
    assert m.headers["subject"] == "Résumé" and m.body == "Hello **bold**" and [n for n, _ in m.attachments] == ["note.txt", "x.bin"]
    assert mail.parse(message(False)).body.strip() == "plain body"
    text, label = mail.compile_email("m.eml", message())
    assert label == "email+extracted_from_email" and "### 1. note.txt (9.0 B)\n\n```text\nnote text\n```\n\n" in text and "[Attachment type '.bin' not supported for extraction]" in text
    text, label = mail.compile_email("m.eml", message(), [("other.md", b"# other")])
    assert label == "email+local_folder" and "note text" not in text and "```markdown\n# other\n```" in text
    assert mail.compile_email("m.eml", b"\xff\xfe\0\1\2\3")[1].startswith("email+")
    (tmp_path / "m.eml").write_bytes(message())
    (tmp_path / "Attachments").mkdir()
    (tmp_path / "Attachments/n.txt").write_bytes(b"from the folder")
    done = report.compile_folder(spark, report.Options(str(tmp_path), str(tmp_path / "o.md"), when=NOON))
    out = (tmp_path / "o.md").read_text()
    assert done.mode == "single_email" and "- **SPF**: Pass\n- **DKIM**: Fail\n" in out and "- **Types**: TXT (1)" in out and "from the folder" in out
    assert report.compile_folder(spark, report.Options(str(tmp_path), str(tmp_path / "o.md"), standard=True)).mode == "standard"


def test_html_and_documents():
    out = converters.html_tables_to_markdown("before <div><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table></div> after")
    assert out == "before | A | B |\n| --- | --- |\n| 1 | 2\\|3 | after" and converters.html_tables_to_markdown("no table") == "no table"
    assert converters.html_to_markdown("<h2>T</h2><p>a<p>b <a href='u'>l</a><script>'</p>'</script>") == "## T\n\na\n\nb [l](u)"
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    docx = archive(word__document_DOT_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    assert converters.convert("f.DOCX", docx, {"docx": ["builtin-docx"]}) == ("One\n\nTwo", "builtin-docx")
    assert converters.convert("f.docx", b"junk")[1] == "failed" and converters.convert("f.rtf", b"not rtf")[1] == "failed" and converters.convert("f.doc", b"x")[1] == "failed"
    assert converters.convert("f.epub", archive(p_DOT_xhtml="<h1>Book</h1><p>text</p>"))[0] == "# Book\n\ntext"
    assert converters.pdf_to_text(b"1 0 obj stream\nBT (Hello \\(pdf\\)) Tj T* [(wor) -3 (ld)] TJ ET\nendstream") == "Hello (pdf)\nworld"
    assert converters.rtf_to_text(rb"{\b One\par}{Two}") == "One\nTwo"


def test_benchmark(spark, tmp_path):
    paths = []
    for k, text in enumerate((rb"{\rtf1 one two}", rb"{\rtf1 three}")):
        paths.append(str(tmp_path / f"{k}.rtf"))
        open(paths[-1], "wb").write(text)
    results, order = benchmark.run_benchmark(spark, paths, str(tmp_path / "out"), 2)
    assert order == {"rtf": ["builtin-rtf"]} and [r["rank"] for r in results] == [1, 1] and all(r["accuracy"] == 1 for r in results)
    assert json.load(open(tmp_path / "out/converter_ranking.json")) == order
    assert benchmark.fastest(str(tmp_path / "out/converter_ranking.json")) == order and benchmark.fastest("/no/file") == {}


def test_command_line(tree, spark, capsys, tmp_path):
    assert cli.main([str(tree), "-r", "-o", str(tmp_path / "o.md"), "-e", "txt, md", "-x", "^_,("]) == 0
    assert (tmp_path / "o.md").exists() and "Not a regular expression" in capsys.readouterr().err
    assert cli.main(["-v"]) == 0 and cli.main([]) == 0 and cli.suffixes(".pdf,TXT") == ("..pdf", ".txt")
    with pytest.raises(SystemExit) as e:
        cli.main([str(tree), "--pdf-converters", "nonsense"])
    assert e.value.code == 1


def test_streaming(spark, tree, tmp_path):
    for _ in range(2):
        ingest.follow(spark, str(tree), str(tmp_path / "t"), str(tmp_path / "c"), (".txt",)).awaitTermination()
        assert {os.path.basename(r.path): (r.chars, r.tokens) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a.txt": (16, 3)}
        assert spark.read.parquet(str(tmp_path / "t")).count() == 1
