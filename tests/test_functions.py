import difflib
import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import mail
from paperloom.operators.converters import pipe_table
from paperloom.sources.files import decoded

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
ODD = st.lists(st.sampled_from([*"ab.!? \n\t\r\x1c\x85\xa0　|", "é", "word"]), max_size=12).map("".join)


def tokens(t):
    return len(t.split()) + (t.strip()[-1:] in (".", "!", "?") if t.strip() else 0)


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


@LOOSE
@given(st.lists(ODD, min_size=30, max_size=60))
def test_tokens(spark, texts):
    assert column(spark, texts, "string", T.token_count) == list(map(tokens, texts))
    assert column(spark, texts, "string", T.strip) == [t.strip() for t in texts]


def test_known_tokens_and_sizes(spark):
    assert column(spark, ["", "  ", "Hello world.", "a b c"], "string", T.token_count) == [0, 0, 3, 3]
    sizes = [0, 500, 1023, 1024, 1280, 1310720, 2 * 2**20, 2 * 2**30, 2 * 2**40, 3000 * 2**40, *range(1000, 200_000, 617)]
    assert column(spark, sizes, "long", T.human_size) == list(map(mail.human_size, sizes))


@LOOSE
@given(st.lists(st.text(st.sampled_from("ab.-_ Z"), min_size=1, max_size=8), min_size=30, max_size=60))
def test_extensions(spark, names):
    assert column(spark, names, "string", T.extension) == [os.path.splitext(n.lower())[1] for n in names]


@LOOSE
@given(st.lists(st.lists(st.lists(st.one_of(st.none(), ODD), max_size=4), max_size=4), min_size=20, max_size=40))
def test_tables(spark, tables):
    assert column(spark, tables, "array<array<string>>", T.markdown_table) == list(map(pipe_table, tables))
    cells = [[c for r in t for c in r] for t in tables]
    assert column(spark, tables, "array<array<string>>", T.cell_density) == [sum(bool((c or "").strip()) for c in x) / len(x) if x else 0.0 for x in cells]


@LOOSE
@given(st.lists(st.binary(max_size=12), min_size=30, max_size=60))
def test_decoding(spark, blobs):
    assert column(spark, blobs, "binary", decoded) == [b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for b in blobs]


def test_similarity():
    assert [T.similarity(a, b) for a, b in (("a b", "a b"), ("", ""), ("a", ""), ("a b", "c d"))] == [1.0, 1.0, 0.0, 0.0]
    assert 0 < T.similarity("a b c", "a x c") < 1


@LOOSE
@given(st.randoms(use_true_random=False))
def test_word_ratio(rng):
    """The same as the standard library's, also where words of long texts count as popular."""
    for k in range(200):
        words = [*map(str, range(rng.choice([1, 3, 30, 300])))]
        weights = [1 / (n + 1) for n in range(len(words))] if k % 2 else None
        a, b = (rng.choices(words, weights, k=rng.choice(sizes)) for sizes in ([1, 7, 40], [1, 60, 199, 200, 450]))
        b[len(b) // 2 : 0] = a[: k % 5]
        assert T.word_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
