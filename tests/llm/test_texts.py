"""Operators on single texts and conversations: packing, token files, toxicity, language, chat."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import chat, common, language, packing, token_files, tokens, toxicity

ODD = st.lists(st.sampled_from([*"ab'.!  \n\n\t\r\x1c \u0085\u3000\u00e9\u03a31<|>\0", "\u0301", "<|endoftext|>", "'s"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_pieces_give_the_library_s_ids(texts):
    for file, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        e = tokens.encoder(public_tokenizers.path(file), kind)
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def library_ids(texts, file, end):
    t = tokens.encoder(public_tokenizers.path(file), "byte" if "byte" in file else "word").tokenizer
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(make, edge_texts, edge_ids):
    ids = library_ids(edge_texts, "word_bpe_49k.json", 2)
    rows = packing.pack(make(edge_texts, edge_ids).repartition(3)).collect()
    for i, own in zip(edge_ids, ids):
        pieces = sorted((r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows if r.doc_id == i)
        at = 0
        for start, n, check, data in pieces:
            assert start == at and check == crc(own[at : at + n]) and data == np.array(own[at : at + n], "<u4").tobytes()
            at += n
        assert at == len(own) and {r.doc_tokens for r in rows if r.doc_id == i} == {len(own)}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 4096 and r.padding == (0 if at & (at - 1) == 0 else 4096 - at)
    assert packing.op3(make([])).count() == 0


def test_little_padding(spark):
    rows = packing.op3(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sizes = [r.n for r in rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(packing.padding(n) for n in sizes) < 0.02 * sum(sizes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=9), st.integers(9, 15))
def test_cuts_are_the_best(steps, width):
    places = list(itertools.accumulate(x for x, _ in steps))
    costs = [c for _, c in steps]

    def cost(cuts):
        return sum(width - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(costs[places.index(c)] for c in cuts)

    got = packing.best_cuts(places, costs, width, True)
    every = [[*c, places[-1]] for k in range(len(places)) for c in itertools.combinations(places[:-1], k)]
    fit = [c for c in every if all(b - a <= width for a, b in zip([0, *c], c))]
    assert got in fit and cost(got) == min(map(cost, fit))


def test_token_files(spark, make, edge_texts, edge_ids, tmp_path):
    docs, folder = make(edge_texts, edge_ids).repartition(5), f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(docs, folder)
    ids = dict(zip(edge_ids, library_ids(edge_texts, "byte_bpe_50k.json", 0)))
    at = 0
    rows = {r.doc_id: r for r in token_files.read_tokens(spark, folder).collect()}
    for i in sorted(ids, key=lambda x: common.NULL_ID if x is None else x):
        assert rows[i].start == at and rows[i].n_tokens == len(ids[i]) and bytes(rows[i].ids) == np.array(ids[i], "<u4").tobytes()
        at += len(ids[i])
    assert manifest["tokens"] == at
    got = {r.doc_id: r for r in token_files.op8(docs).collect()}
    assert all(got[i].ids_crc32 == crc(x) and got[i].start == rows[i].start for i, x in ids.items())
    assert token_files.op8(make([])).count() == 0


def test_toxicity(spark, make, edge_texts, edge_ids):
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    rows = toxicity.op9(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted for r in rows if r.toxic == 1)
    assert hit >= 0.78 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)
    model = toxicity.fit(["you idiot there", "all is well here", "an idiot again", "well then"] * 20, [1, 0, 1, 0] * 20)
    got = {r.doc_id: r.score for r in toxicity.score(make(edge_texts, edge_ids), model).collect()}
    assert len(got) == len(edge_ids) and all(0 <= x <= 1 for x in got.values()) and got[0] == got[1] == got[2]
    clash = make(["so well said", None]).selectExpr("*", "1 _toxic_score", "2 _x0", "3 `a.b`", "4 _text_to_score")
    assert toxicity.drop_toxic(clash, labels.limit(0)).schema == clash.schema and toxicity.drop_toxic(clash, labels.limit(0)).count() == 2
    dropped = toxicity.drop_toxic(make(["so well said", None]), labels.limit(0))
    assert dropped.columns == make([]).columns and dropped.count() == 2
    assert toxicity.op9(make([]), labels.limit(0)).count() == 0
    null = spark.createDataFrame([(None, 1), (3, None), (5, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.op9(make(["bad", "good"], [5, 4]), null).count() == 2


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def slow_features(text):
    """Words, pairs of neighbours and pairs with one word between, as byte strings."""
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return {(x,) for x in w} | {("pair", *x) for x in zip(w, w[1:])} | {("skip", *x) for x in zip(w, w[2:])}


def slow_ftrl(texts, labels, alpha=5.0, beta=1.0, l1=4.0, l2=0.01, epochs=4, seed=7):
    """FTRL-proximal as in the papers, a feature at a time."""
    rows, share = [slow_features(t) for t in texts], min(max(sum(labels) / len(labels), 1e-6), 1 - 1e-6)
    often = collections.Counter(f for r in rows for f in r)
    rows = [[f for f in r if often[f] >= toxicity.LEAST_ROWS] for r in rows]
    z, n, bias, bias_n = collections.defaultdict(float), collections.defaultdict(float), math.log(share / (1 - share)), 0.0

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            w = {f: weight(f) for f in rows[k]}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[k]
            for f, x in w.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * x
                n[f] += g * g
            bias_n += g * g
            bias -= 0.1 / (1 + math.sqrt(bias_n)) * g
    weights = {f: weight(f) for f in z}
    return lambda t: 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in slow_features(t)))))


def test_toxicity_against_a_slow_version(spark, make, edge_texts):
    """op9's scores, from the choice of the rows to the weights, are those of a plain FTRL over plain features."""
    rng = random.Random(20)
    say = lambda bad, n: " ".join(rng.choice(["vile", "Scum!", "you are", "trash,"] if bad and rng.random() < 0.3 else ["tree", "Haus", "walks", "to", "the", "shop.", "été", "x"]) for _ in range(n))
    toxic = [rng.random() < 0.3 for _ in range(400)]
    texts = [say(b, rng.randint(1, 40)) for b in toxic] + edge_texts
    ids = [*range(len(texts) - 1), None]
    labels = [(k, int(b)) for k, b in enumerate(toxic) if k % 3] + [(5000, 1), (None, 1), (7, None), (8, 1), (8, 0)]
    held = held_out
    y = {k: max(b for j, b in labels if j == k and b is not None) for k in sorted({k for k, b in labels if k is not None and b is not None and k < len(texts)}) if not held(k)}
    score = slow_ftrl([texts[k] for k in y], list(y.values()))
    got = {r.doc_id: r for r in toxicity.op9(make(texts, ids), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(texts)
    for k, t in zip(ids, texts):
        assert math.isclose(got[k].score, score(t), abs_tol=1e-9) and got[k].predicted == (score(t) >= 0.3) and got[k].held_out == (k is not None and held(k))
    assert len({r.predicted for r in got.values()}) == 2


def test_the_samples_are_bounded_by_bytes(spark, make):
    docs = make([f"text number {k} " + "word " * 20 for k in range(100)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, sample_bytes=0).bias == toxicity.fit([], []).bias
    assert len(toxicity.train(docs, labels, sample_bytes=1000).hashes) <= len(toxicity.train(docs, labels).hashes)
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 70))
    held = held_out
    assert language.train(many, sample_rows=10, sample_bytes=10).labels == sorted({f"l{k % 70}" for k in range(100) if not held(k)})


def test_a_long_word_counts_whole():
    word = "ab" * 30
    assert language.word_features(word, {}) != language.word_features(word[:12] + "xyz" * 12 + word[48:], {})


def slow_label(model, text):
    """The expected share of letters by sums over all labellings of short texts."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    k = len(model.labels)
    scores = [sum((model.weights[i] for i in language.word_features(w, model.lexicon)), np.zeros(k)) for w in words]
    share, total = np.zeros(k), 0.0
    for path in itertools.product(range(k), repeat=len(words)):
        p = math.exp(model.start[path[0]] + sum(s[y] for s, y in zip(scores, path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
        total += p
        for w, y in zip(words, path):
            share[y] += p * len(w)
    return share / total / sum(map(len, words))


def test_language_against_all_labellings(spark, make):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(docs, sample=20)
    texts = ["the house", "la maison des", "und der " + "Donaudampfschiff" * 4, "el perro the der", "x", "été 12 a"]
    for r in language.identify(make(texts), model).collect():
        want = slow_label(model, texts[r.doc_id])
        assert np.allclose([r.shares[x] for x in model.labels], want, atol=2e-3) and r.lang_pred == model.labels[int(want.argmax())]


def test_marginals_are_exact():
    rng = np.random.default_rng(4)
    k, lengths = 3, np.array([4, 1, 0, 3])
    s, tr, start = rng.normal(size=(8, k)).astype(np.float32), rng.normal(size=(k, k)), rng.normal(size=k)
    got, moved, first = language.forward_backward(s, lengths, tr, start, pairs=True)
    at, all_moved, all_first = 0, np.zeros((k, k)), np.zeros(k)
    for n in lengths:
        p, total, m, f = np.zeros((n, k)), 0, np.zeros((k, k)), np.zeros(k)
        for path in itertools.product(range(k), repeat=int(n)) if n else []:
            w = np.exp(start[path[0]] + sum(s[at + t, y] for t, y in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:])))
            total += w
            f[path[0]] += w
            for t, y in enumerate(path):
                p[t, y] += w
            for a, b in zip(path, path[1:]):
                m[a, b] += w
        if n:
            assert np.allclose(got[at : at + n], p / total, atol=1e-4)
            all_moved, all_first = all_moved + m / total, all_first + f / total
        at += n
    assert np.allclose(moved, all_moved, atol=1e-3) and np.allclose(first, all_first, atol=1e-3)


def test_language(spark, make, edge_texts, edge_ids):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.op6(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    model = language.train(docs, sample=40)
    got = {r.doc_id: r for r in language.identify(make(edge_texts, edge_ids), model, words_at_once=50).collect()}
    assert len(got) == len(edge_ids)
    for i, t in zip(edge_ids, edge_texts):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i].score <= 1
    by = {r.lang: r.text for r in docs.where("lang in ('en', 'de')").orderBy("n_chars").limit(40).collect()}
    mixed = language.Labeller(model).words(by["en"] + " " + by["de"] + " " + by["en"])
    n, m = len(language.words_of(by["en"])), len(language.words_of(by["de"]))
    want = ["en"] * n + ["de"] * m + ["en"] * n
    assert sum(a == b[1] for a, b in zip(want, mixed)) >= 0.8 * len(want)
    assert language.op6(make([])).count() == 0
    assert [r.lang_pred for r in language.op6(make(["text"]).withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[SAYS]"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", " ", "\n", "x", "/", ">"]), max_size=8).map("".join)), max_size=5))
def test_templates_can_be_read_back(turns):
    pieces = [chat.render(*t) for t in turns]
    assert list(chat.parse("".join(p for p, _, _ in pieces))) == turns
    assert [chat.unescape(p[a:b]) for p, a, b in pieces] == [t if r == "assistant" else "" for r, t in turns]


def test_chat(spark):
    rows = [(1, 0, "system", "s", 9), (1, 1, "user", None, 9), (1, 2, "assistant", "x" * 200_000, 9), (1, 2, "assistant", "again", 9), (1, 2, "assistant", "again", 9), (None, 0, None, "t", 9), (2, None, "user", "\\<s>[INST]", 9)]
    got = {r.conv_id: r for r in chat.op7(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]", 9), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 9)]
    for c in {r[0] for r in rows}:
        own = sorted((-1 if t is None else t, r or "", x or "") for i, t, r, x, _ in rows if i == c)
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render(r, x)[0]) for _, r, x in own)
    assert [r.conv_id for r in chat.op7(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-7]


def test_events(spark):
    rng = random.Random(3)
    log = [(1, 0, 0, "message", "user", "q"), (1, 1, 1, "message", "assistant", "He"), (1, 2, 1, "delta", None, "llo"), (1, 3, 2, "message", "user", "more"), (1, 4, 3, "message", "assistant", "old"), (1, 5, 1, "regenerate", None, ""), (1, 6, 1, "delta", None, "Hi "), (1, 7, 1, "delta", None, "there"), (1, 8, 2, "message", "user", "new"), (1, 9, 0, "edit", None, "Q")]
    log += [(2, 0, 0, "message", "assistant", "")] + [(2, k, 0, "delta", None, f"{k} ") for k in range(1, 9001)]
    rng.shuffle(log)
    got = chat.messages(spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string"))
    assert {(r.turn, r.text) for r in got.where("conv_id = 1").collect()} == {(0, "Q"), (1, "Hi there"), (2, "more"), (2, "new"), (3, "old")}
    pieces = chat.formatted(spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string")).collect()
    text = "".join(r.piece for r in sorted((r for r in pieces if r.conv_id == 1), key=lambda r: r.turn))
    assert list(chat.parse(text)) == [("user", "Q"), ("assistant", "Hi there"), ("user", "new")]
    assert next(chat.parse(next(r.piece for r in pieces if r.conv_id == 2)))[1] == "".join(f"{k} " for k in range(1, 9001))
    with pytest.raises(ValueError):
        chat.fold([(0, "nonsense", "", "")])


def test_the_driver_forgets_what_is_done(spark, monkeypatch):
    monkeypatch.setattr(common, "COLLECTED_EVERY", 0, raising=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.written(spark.range(3), "small")
    assert full() > before


@pytest.mark.parametrize("file, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_an_encoder_holds_no_more_than_it_is_told(file, kind):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeiouthnsAÉßœÿ", k=rng.randint(1, 9))) + rng.choice(["", "", ".", "%%%", "'s", "'", "-x", "3", ".\nThen"])
    texts = [" ".join(word() for _ in range(300)) for _ in range(4)] + ["İ. İ, xİ."]
    e = tokens.encoder(public_tokenizers.path(file), kind, 50)
    try:
        assert e.encode(texts) == e.encode_batch(texts)
        assert len(e.known) <= 50
    finally:
        tokens.encoder(public_tokenizers.path(file), kind)
