"""Each stage of the pipeline against a version of its own that knows nothing of the library, and all on odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import catalog, common
from tests.llm.test_pairs import components, low, slow_leaks, slow_lines
from tests.llm.test_texts import crc, held_out, library_ids, slow_ftrl


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents, labels and benchmark with nulls, repeats, copies, leaks, toxic texts and clashing columns."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(1, say(30)), (2, say(15)), (None, say(22)), (3, None), (4, "few words")]
    common_lines = [say(12), say(60), "All rights reserved", "x"]
    docs = [(0, None), (1, ""), (2, " \n"), (None, say(50)), (None, say(50)), (None, None)]
    for k in range(3, 160):
        text = "\n".join(rng.choice(common_lines) if rng.random() < 0.2 else say(rng.randint(4, 40)) for _ in range(rng.randint(1, 5)))
        if k % 9 == 0:
            text += "\n" + say(8) + " " + rng.choice(items[:3])[1] + " " + say(8)
        if k % 4 == 0:
            text = " ".join(x if rng.random() < 0.7 else rng.choice(["vile", "scum"]) for x in text.split(" "))
        docs.append((k, text))
    for k in range(160, 190):  # one long line with a few words changed
        w = docs[rng.randrange(6, 150)][1].replace("\n", " ").split() * 3
        for x in (160, 190):
            w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((k + x, " ".join(w)))
    docs += [docs[10], docs[10], (docs[11][0], say(40))]
    d = str(tmp_path_factory.mktemp("tables"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], columns).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("vile" in (t or "") or "scum" in (t or ""))) for i, t in docs if i is not None], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_stages(spark, folder):
    d, docs, items = folder
    table = common.table(spark, d, "documents")
    labels = {r.doc_id: r.toxic for r in common.table(spark, d, "labels").collect()}
    largest = {i: max(t or "" for j, t in docs if j == i) for i in labels}
    y = {i: labels[i] for i in sorted(labels) if not held_out(i)}
    score = slow_ftrl([largest[i] for i in y], list(y.values()))

    def toxicity(rows):
        return [r for r in rows if score(r[1]) < 0.3]

    def lines(rows):
        out = slow_lines(spark, rows)
        return [(i, t) for i, _, k, t in out if not (k and not t.strip())]

    def near(rows):
        hashes = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, t string").select("k", common.text_key(F.col("t")).alias("h")).collect()
        by = {r.k: r.h for r in hashes}
        order = sorted(range(len(rows)), key=lambda k: (low(rows[k][0]), by[k]))
        sets = [shingles(rows[k][1]) for k in order]
        tops = components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9)
        return [rows[order[k]] for k, top in enumerate(tops) if top == k]

    def leaks(rows):
        numbered = list(enumerate(t for _, t in rows))
        gone = {k for k, _ in slow_leaks(numbered, items)}
        return [r for k, r in enumerate(rows) if k not in gone]

    seen, sizes = table, []
    for (name, stage), slow in zip(corpus_pipeline.STAGES, (toxicity, lines, near, leaks, None)):
        clash = seen.selectExpr("*", "1 _x0", "2 _x1", "3 h", "4 id", "5 score", "6 least", "7 part")
        out = common.written(stage(spark, seen, d), "test")
        rows = [(r.doc_id, r.text) for r in seen.collect()]
        if slow:
            assert out.schema == seen.schema, name
            want = sorted(slow(rows), key=repr)
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want, name
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
            assert stage(spark, clash, d).columns == clash.columns, name
            assert stage(spark, seen.limit(0), d).count() == 0
            sizes.append((len(rows), len(want)))
        else:
            pieces = out.collect()
            ids = dict(zip(rows, library_ids([t for _, t in rows], "word_bpe_49k.json", 2)))
            assert sorted((r.doc_id, r.ids_crc32) for r in pieces if r.length == r.doc_tokens and r.doc_id is not None) == sorted((i, crc(x)) for (i, _), x in ids.items() if i is not None and any(r.doc_id == i and r.length == r.doc_tokens == len(x) for r in pieces))
            assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
            assert stage(spark, seen.limit(0), d).count() == 0
        seen = out
    assert all(b < a for a, b in sizes), sizes
    assert rows_of(corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32")) == rows_of(seen.select("doc_id", "start", "length", "ids_crc32"))


def test_catalog():
    assert sorted(int(x[2:].split("_")[0]) for x in catalog.queries()) == list(range(1, 11))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
