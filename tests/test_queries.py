import difflib
import html
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from paperloom import catalog
from paperloom.functions.text import similarity
from paperloom.operators import batches, relations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    a = sorted(key([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(key(map(plain, r)) for r in want.fetchall())
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_word_bound(spark):
    """All words count, short and common ones too, and no similarity is above the bound."""
    docs = [(0, "a b a c"), (1, ""), (2, "x y z"), (3, "c a\tb\na q"), (4, None)]
    items = [(0, "a a b"), (1, "c"), (2, " ")]
    rows = catalog.word_bound(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.common, r.doc_words, r.item_words, r.bound) for r in rows}
    want = {}
    for i, t in docs:
        for k, u in items:
            a, b = Counter((t or "").split()), Counter(u.split())
            n, m, c = a.total(), b.total(), (a & b).total()
            if c or n == m == 0:
                want[i, k] = (c, n, m, 2 * c / (n + m) if n + m else 1.0)
            assert similarity(u, t) <= want.get((i, k), (0.0,))[-1] + 1e-9
    assert got == want and len(rows) == len(got)


def test_best_similarity(spark, sf_dir):
    """Each document against the item with the highest bound, the same as by a loop over all pairs."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, "zzz")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for i, t in docs:
        bounds = []
        for k, u in items:
            a, b = Counter((t or "").split()), Counter(u.split())
            if c := (a & b).total():
                bounds.append((-2 * c / (a.total() + b.total()), k, u))
        if bounds:
            _, k, u = min(bounds)
            want[i] = (k, round(similarity(u, t), 4))
    got = catalog.best_similarity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.item_id, r.similarity) for r in got} == want and len(got) == len(want) > 10


def odd_words(spark):
    """Documents and items with repeated and null ids, null, empty and long texts."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices("abcdefghij", range(1, 11), k=n))
    docs = [(1, "a b"), (1, "a b"), (1, "c c c"), (None, "a\u3000q\x1cb"), (2, None), (3, " "), (4, "zz"), *[(5 + k, say(k)) for k in range(0, 700, 9)]]
    items = [(7, "a b"), (3, "b a"), (None, "j j i"), (7, "c"), (9, ""), (8, None), *[(10 + k, say(k)) for k in range(1, 60, 3)]]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")


def test_best_similarity_of_rows(spark):
    """Every row against its own nearest item, of equals the one with the smallest id, without a shuffle."""
    docs, items, d, i = odd_words(spark)
    got, want = catalog.best_similarity(d, i), []
    for key, t in docs:
        a, least = Counter((t or "").split()), []
        for k, u in items:
            b = Counter((u or "").split())
            c, n = (a & b).total(), a.total() + b.total()
            if c or not n:
                least.append((-2 * c / n if n else -1.0, k is not None, k or 0, u or ""))
        if least:
            _, _, k, u = min(least)
            ws, vs = u.split(), (t or "").split()
            want.append((key, k or None, round(difflib.SequenceMatcher(None, ws, vs).ratio() if ws and vs else 1.0, 4)))
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) > 70
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_word_bound_of_rows(spark):
    """Rows that repeat an id are documents of their own, and no row leaves its task."""
    docs, items, d, i = odd_words(spark)
    got, want = catalog.word_bound(d, i), []
    for key, t in docs:
        for k, u in items:
            a, b = Counter((t or "").split()), Counter((u or "").split())
            c, n, m = (a & b).total(), a.total(), b.total()
            if c or n == m == 0:
                want.append((key, k, c, n, m, 2 * c / (n + m) if n + m else 1.0))
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) > 1000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_attachment_folder(spark):
    emails = spark.createDataFrame([("a", "a/m.eml"), ("", "n.eml"), ("b", "b/o.eml"), ("c", "c/p.eml")], "dir string, rel_path string")
    files = spark.createDataFrame([("a/Attachments",), ("a/attachment",), ("Attachment",), ("b/other",), ("d/attachments",)], "dir string")
    got = {r.rel_path: r.folder for r in relations.attachment_folder(emails, files).collect()}
    assert got == {"a/m.eml": "a/Attachments", "n.eml": "Attachment", "b/o.eml": None, "c/p.eml": None}


def test_converters_of_pages_and_messages(spark, sf_dir):
    """What the queries without SQL give, against what was put in."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    q = catalog.queries()
    zips = q["q_zip_members"](spark, sf_dir).collect()
    assert len(zips) == len(texts) and all(texts[r.doc_id].strip() in r.text for r in zips)
    mails = q["q_email_compile"](spark, sf_dir).collect()
    assert all(f"# Email Document: document {r.doc_id}" in r.text and " ".join(texts[r.doc_id].split()) in " ".join(r.text.split()) and r.method == "email+extracted_from_email" for r in mails)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in q["q_html_to_markdown"](spark, sf_dir).collect():
        said = re.findall(r"<p>([^<]*)</p>", pages[r.page_id])
        assert all(" ".join(html.unescape(x).split()) in " ".join(r.markdown.split()) for x in said)


def test_pages_come_in_small_batches(spark, tmp_path):
    """What a worker holds doesn't grow with the pages: 300 of 200 KB, one row group, go in and out in pieces."""
    pq.write_table(pa.table({"page_id": range(300), "html": ["<p>" + "x" * 200_000] * 300}), tmp_path / "pages.parquet")
    resident = lambda x: open("/proc/self/statm").read().split()[1] + " " + x[::-1]
    rows = catalog._pages(spark, str(tmp_path), resident, "held").selectExpr("page_id", "int(substring_index(held, ' ', 1)) * 4096 held", "length(held) n").collect()
    assert sorted(r.page_id for r in rows) == list(range(300)) and all(r.n > 200_000 for r in rows)
    held = [r.held for r in sorted(rows)][100:]  # once it has begun
    assert max(held) - min(held) < 8 * batches.BYTES


def test_results_go_out_in_small_batches(spark):
    """Whatever comes in at once; every row stays, null ones and those larger than a batch too."""

    class Rows:
        sparkSession, mapInArrow = spark, lambda self, run, schema: run

    texts = [None, "", "x" * (3 * batches.BYTES), *["y" * 30_000] * 500, *["z"] * 5000]
    run = batches.map_rows(Rows(), lambda i, t: (i, t and t * 2), "i long, t string")
    out = list(run(iter([pa.record_batch({"i": range(len(texts)), "t": texts}), pa.record_batch({"i": [-1], "t": ["w"]})])))
    assert all(b.num_rows <= batches.ROWS and (b.num_rows == 1 or b.slice(0, b.num_rows - 1).column(1).nbytes < 2 * batches.BYTES) for b in out)
    rows = [(r["i"], r["t"]) for b in out for r in b.to_pylist()]
    assert rows == [*[(i, t and t * 2) for i, t in enumerate(texts)], (-1, "ww")]


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.chars, r.path))
