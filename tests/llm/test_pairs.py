"""Operators on pairs against brute force: SimHash, exact dedup, line dedup, decontamination, sharding."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import common, decontaminate, exact_dedup, line_dedup, sharding, simhash

low = lambda i: common.NULL_ID if i is None else i


def slow_fingerprint(text, words=4):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, linked):
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(values))]


def test_masks_cover_the_radius():
    masks = [m & 2**64 - 1 for m in simhash.covering_masks(4)]
    rng = random.Random(1)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not differ & m for m in masks)
    assert len(masks) == 31 and all(m.bit_count() >= 30 for m in masks)


@pytest.mark.parametrize("radius, least", [(2, 30), (5, 32), (6, 32), (7, 16)])
def test_masks_of_any_radius_cover_and_keep_enough_bits(radius, least):
    masks = [m & 2**64 - 1 for m in simhash.covering_masks(radius)]
    rng = random.Random(radius)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not differ & m for m in masks)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= least


def test_simhash_components(make, edge_texts, edge_ids):
    got = {r.doc_id: r for r in simhash.op10(make(edge_texts, edge_ids)).collect()}
    fps = [slow_fingerprint(t) for t in edge_texts]
    order = sorted(range(len(fps)), key=lambda k: low(edge_ids[k]))
    tops = components([fps[k] for k in order], lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(got) == len(edge_ids)
    for k, top in zip(order, tops):
        assert got[edge_ids[k]].fingerprint == f"{fps[k]:016x}"
        assert got[edge_ids[k]].component_id == edge_ids[order[top]]


def test_simhash_links_of_chains_and_large_buckets(spark):
    rng = random.Random(2)
    values = []
    for _ in range(30):
        x = rng.getrandbits(64)
        values.append(x)
        for _ in range(20):  # chains whose ends are far apart
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v, v) for v in signed], "fp long, rep long")
    for block in (8192, 7):
        found = {r.node: r.component for r in common.connected_components(simhash.near_edges(table, 4, block)).collect()}
        tops = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
        groups = {}
        for v, top in zip(signed, tops):
            groups.setdefault(top, []).append(v)
        for g in groups.values():
            assert {found.get(v, v) for v in g} == {min(g)}


def test_simhash_buckets_are_not_broadcast(spark):
    """Spark takes the rows of all masks for few, as it sizes an explosion like its input; by default it would broadcast them."""
    table = spark.range(2000).selectExpr("xxhash64(id) fp", "xxhash64(id) rep")
    edges = simhash.near_edges(table, 4)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_keep_one(make, edge_texts):
    docs = make(edge_texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 5 in ids and not {6, 8, 9} & ids and {10, 14, 15} <= ids and 4 not in ids


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_keep_one_of_repeated_and_null_ids(make, vocabulary, similarity):
    """A text that only shares its id with one that goes stays; of rows equal in id and text one stays."""
    rng = random.Random(17)
    p, q, r = (" ".join(rng.choices(vocabulary, k=60)) for _ in range(3))
    docs = [(3, p), (5, p), (5, q), (None, r), (None, r), (9, r), (None, None), (4, ""), (None, None), (7, " "), (8, q + " " + p), (8, q + " " + p)]
    table = make([t for _, t in docs], [i for i, _ in docs]).selectExpr("*", "1 _gone", "2 _x0", "3 _x1", "4 `a.b`", "5 component", "6 least")
    kept = simhash.keep_one(table, similarity=similarity)
    assert kept.schema == table.schema
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted([(3, p), (5, q), (None, r), (None, None), (8, q + " " + p)], key=repr)


def test_near_copies_by_similarity(make, vocabulary):
    """Links are the pairs with five-word Jaccard of 0.8 or more, most of them more than 6 bits apart."""
    import corpus_pipeline

    rng = random.Random(12)
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 300]))
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    ids = [*range(1, len(texts)), None]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    order = sorted(range(len(texts)), key=lambda k: low(ids[k]))
    sets = [shingles(texts[k]) for k in order]
    tops = components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9)
    want = {ids[k]: ids[order[top]] for k, top in zip(order, tops)}
    fps = [slow_fingerprint(texts[k], 5) for k in order]
    pairs = [(fps[i] ^ fps[j]).bit_count() for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 50 and sum(d > 6 for d in pairs) > len(pairs) // 3
    docs = make(texts, ids)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_copies(None, docs, "").collect()} == {i for i, c in want.items() if i == c}
    assert simhash.near_duplicates(make([]), **corpus_pipeline.NEAR).count() == 0


def slow_long_fingerprint(hashes):
    """As one number of TABLES * 16 bits."""
    mask, sums = 2**64 - 1, [0] * (simhash.TABLES * 16)
    for h in hashes:
        for w, factor in enumerate(simhash._FACTORS.tolist()):
            x = h * factor & mask
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
            x ^= x >> 32
            for b in range(64):
                sums[w * 64 + b] += 1 if x >> b & 1 else -1
    return sum(1 << b for b, n in enumerate(sums) if n > 0)


def test_long_fingerprints(vocabulary):
    """Bits are those of a majority; pairs at Jaccard 0.8 differ in some 15 % of them, whatever the place of a bit, unrelated ones in half."""
    rng = random.Random(31)
    hashes = lambda n: [rng.getrandbits(64) for _ in range(n)]
    for n in (1, 2, 5, 254, 255, 256, 600):
        own = sorted(hashes(n))
        bits = simhash.long_fingerprint(np.array(own, np.uint64))
        whole = sum(x << (64 * k) for k, x in enumerate(bits.tolist()))
        assert whole == slow_long_fingerprint(own)
        assert simhash.buckets_of(np.array(own, np.uint64), bits)[: simhash.TABLES] == [(t << simhash.BITS) + (whole >> 16 * t) % 2**simhash.BITS for t in range(simhash.TABLES)]
    near, far = np.zeros(simhash.TABLES * 16, int), np.zeros(simhash.TABLES * 16, int)
    say = lambda n: [" ".join(rng.choices(vocabulary, k=5)) for _ in range(n)]
    bits_of = lambda grams: np.unpackbits(simhash.long_fingerprint(np.unique([xxhash.xxh64_intdigest(g, 42) for g in grams]).astype(np.uint64)).view(np.uint8), bitorder="little")
    for _ in range(200):
        base = say(160)
        a, b = bits_of(base + say(20)), bits_of(base + say(20))
        near += a != b
        far += a != bits_of(say(180))
    assert abs(near.mean() / 200 - 0.1515) < 0.005 and near.max() / 200 < 0.27
    assert abs(far.mean() / 200 - 0.5) < 0.01


def test_close_edges(spark):
    """Those of brute force over all that share a bucket, in small groups and in groups dealt out in blocks; a bucket below zero joins whatever the bits."""
    rng = random.Random(32)
    rows, word = [], lambda: rng.getrandbits(192)
    for _ in range(25):
        x, buckets = word(), rng.sample(range(40), 3)
        for _ in range(rng.randint(1, 12)):
            rows.append((x, sorted({*buckets[: rng.randint(1, 3)], rng.randrange(40)} | ({-5} if rng.random() < 0.05 else set()))))
            for b in rng.sample(range(192), rng.randint(1, 70)):
                x ^= 1 << b
    crowd = word()
    rows += [(crowd ^ sum(1 << b for b in rng.sample(range(192), 20)), [77]) for _ in range(300)] + [(word(), [77]) for _ in range(100)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    table = spark.createDataFrame([(k, *(signed(x >> 64 * p & 2**64 - 1) for p in range(3)), b) for k, (x, b) in enumerate(rows)], "key long, p0 long, p1 long, p2 long, buckets array<int>")
    linked = lambda a, b: bool(s := set(a[1]) & set(b[1])) and (min(s) < 0 or (a[0] ^ b[0]).bit_count() <= simhash.APART)
    want = components(rows, linked)
    assert len(set(want)) < len(want) - 300
    for block in (8192, 50, 3):
        found = {r.node: r.component for r in common.connected_components(simhash.close_edges(table, block)).collect()}
        assert [found.get(k, k) for k in range(len(rows))] == want


def test_near_copies_are_named_by_simhash(spark, make, vocabulary, monkeypatch):
    """No link of short texts is lost (nine words and eight of them); without fingerprints there are no links."""
    rng = random.Random(33)
    texts = []
    for _ in range(150):
        w = rng.choices(vocabulary, k=9)
        texts += [" ".join(w), " ".join(w[:8] if rng.random() < 0.5 else w[1:])]
    docs = make(texts)
    pairs = [r.component_id for r in simhash.near_duplicates(docs, words=5, similarity=0.8).orderBy("doc_id").collect()]
    assert pairs == [k // 2 * 2 for k in range(300)]
    monkeypatch.setattr(simhash, "close_edges", lambda prints: prints.selectExpr("key a", "key b").limit(0))
    assert [r.component_id for r in simhash.near_duplicates(docs, words=5, similarity=0.8).orderBy("doc_id").collect()] == list(range(300))


def test_set_edges_in_blocks(spark, make, vocabulary, monkeypatch):
    monkeypatch.setattr(simhash.similar_edges, "__defaults__", (3,))
    rng = random.Random(13)
    base = rng.choices(vocabulary, k=200)
    texts = []
    for _ in range(40):  # one chain and one star
        base = list(base)
        base[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    found = simhash.near_duplicates(make(texts), words=5, similarity=0.8).collect()
    assert {r.component_id for r in found} == {0}


def test_exact_dedup(make, edge_texts, edge_ids):
    texts, ids = [*edge_texts, edge_texts[5]], [*edge_ids, 5]
    got = exact_dedup.op4(make(texts, ids)).collect()
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    assert len(got) == len(texts)
    for t in set(norm):
        group = [i for i, n in zip(ids, norm) if n == t]
        keep = min(group, key=low)
        rows = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        assert sorted((r.doc_id for r in rows), key=low) == sorted(group, key=low)
        assert {r.keep_id for r in rows} == {keep} and {r.group_size for r in rows} == {len(group)}
        assert [r.doc_id for r in rows if r.kept] == [keep]


def test_chunks_follow_the_content():
    data = random.Random(3).randbytes(60_000)
    ends = exact_dedup.cuts(data)
    moved = exact_dedup.cuts(b"x" * 777 + data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and len(ends) > 10
    assert {data[a:b] for a, b in zip(ends, ends[1:])} & {(b"x" * 777 + data)[a:b] for a, b in zip(moved, moved[1:])}
    assert max(b - a for a, b in zip([0, *ends], ends)) <= exact_dedup.MOST


def slow_lines(spark, docs, t=0.8, least=1):
    """(id, lines, removed, text) of every row: rows in the order of ids, null ones first, and of the texts' hashes where ids repeat."""
    hashes = [r.h for r in spark.createDataFrame([(k, x) for k, (_, x) in enumerate(docs)], "k int, x string").select("k", common.text_key(F.col("x")).alias("h")).orderBy("k").collect()]
    seen, out = [], []
    for (i, text), _ in sorted(zip(docs, hashes), key=lambda d: (low(d[0][0]), d[1])):
        lines, removed = (text or "").split("\n"), []
        for k, line in enumerate(lines):
            s = frozenset(line.encode().lower().split())
            if len(s) < least:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                removed.append(k)
            seen.append(s)
        out.append((i, len(lines) if text is not None else 0, len(removed), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in removed)))
    return sorted(out, key=repr)


def found_lines(rows):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in rows.collect()), key=repr)


@pytest.fixture(scope="module")
def line_docs(vocabulary):
    rng = random.Random(8)
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 12, 25, 60, 150, 400]))) for _ in range(60)]
    docs = [(0, None), (1, ""), (None, base[0]), (2, "a b c\na b c")]
    for i in range(3, 120):
        lines = []
        for _ in range(rng.randint(1, 8)):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: rng.randint(1, len(words))]
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("least", [1, 5])
def test_line_dedup(spark, make, line_docs, least):
    docs = make([t for _, t in line_docs], [i for i, _ in line_docs])
    assert found_lines(line_dedup.dedup_lines(docs, least=least)) == slow_lines(spark, line_docs, least=least)


def test_line_dedup_of_repeated_and_null_ids(spark, make, vocabulary):
    """Rows that repeat an id are documents of their own; of rows equal in id and text one keeps its lines."""
    rng = random.Random(15)
    lines = ["All rights reserved", "L1", "L2", "a b c d", "a b c d e", "", " ", *[" ".join(rng.choices(vocabulary, k=9)) for _ in range(8)]]
    docs = [(5, "L1\nL2"), (5, "L1\nL2"), (1, "A"), (5, "A\nfoo"), (5, "C\nbar"), (None, "A\nB"), (None, "A\nB"), (None, None), (None, None), (7, None), (7, ""), (7, ""), (8, " \n\t")]
    docs += [(rng.choice([None, 2, 3, 3, 3, 9]), "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for _ in range(120)]
    docs += docs[-40:]
    want = slow_lines(spark, docs)
    for tasks in (1, 5):
        rows = make([t for _, t in docs], [i for i, _ in docs]).repartition(tasks)
        assert found_lines(line_dedup.dedup_lines(rows)) == want
    clash = make([t for _, t in docs], [i for i, _ in docs]).selectExpr("*", "1 _key", "2 _id", "3 _gone", "4 _x0", "5 _x1", "6 N_x", "7 n_lines", "8 n_removed", "9 `a.b`")
    again = line_dedup.drop_repeats(clash)
    assert again.columns == clash.columns and again.schema == clash.schema
    rows = again.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((i, t) for i, _, k, t in want if not (k and not t.strip())), key=repr)
    assert {tuple(r[-9:]) for r in rows} == {tuple(range(1, 10))}


@pytest.mark.parametrize("tasks", [1, 4])
def test_line_dedup_keeps_lines_of_few_distinct_words(spark, make, line_docs, tasks):
    """Where five are asked for lines of five words or more of which fewer are distinct stay, within one task and across tasks."""
    rule, more = "| --- | --- | --- |", "* * * * *\n0 0 0 0 0"
    texts = [f"{t or ''}\n{rule}\nx\n{rule}\n{more}" for _, t in line_docs[3:23]]
    docs = make(texts).repartition(tasks, "doc_id")
    got = found_lines(line_dedup.dedup_lines(docs, least=5))
    assert got == slow_lines(spark, list(enumerate(texts)), least=5)
    assert all(r[3].count(rule) == 2 for r in got)


def test_line_dedup_in_blocks_and_second_look(spark, make, line_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    monkeypatch.setattr(line_dedup, "NAMED", 1)
    docs = make([t for _, t in line_docs], [i for i, _ in line_docs])
    assert found_lines(line_dedup.op5(docs)) == slow_lines(spark, line_docs)


def test_line_dedup_names_lines_by_words_met_twice(spark, make):
    """Words that occur once are counted in a line but not sent, and lines travel many in a piece."""
    shared = [" ".join(f"s{k}w{i}" for i in range(20)) for k in range(3)]
    alone = [" ".join(f"a{k}w{i}" for i in range(20)) for k in range(500)]
    texts = ["\n".join(alone[:250]), "\n".join([*alone[250:], *shared]), "\n".join(f"{x} new{k}" for k, x in enumerate(shared))]
    source = line_dedup._source(make(texts), "doc_id", "text")
    rows = line_dedup.distinct_lines(source, *line_dedup.rarity(source), 0.8, 1).collect()
    lines = np.concatenate([np.frombuffer(r.lines, line_dedup.FIRST) for r in rows])
    assert len(lines) == 506 and sorted(lines["n"]) == [20] * 503 + [21] * 3 and len(rows) < 100
    assert sum(lines["size"]) < 60  # some words share a slot
    assert sum(r.n for r in rows) == sum(lines["size"]) and (lines["size"] + lines["skip"] == line_dedup.prefix_length(lines["n"].astype(np.int64))).all()
    assert found_lines(line_dedup.op5(make(texts))) == slow_lines(spark, list(enumerate(texts)))


def test_line_dedup_of_a_very_long_text(spark, make, vocabulary):
    rng = random.Random(16)
    base = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(30)]
    long = [rng.choice(base) if rng.random() < 0.05 else " ".join(rng.choices(vocabulary, k=14)) + f" {k}" for k in range(6000)]
    docs = [(0, "\n".join(base)), (1, "\n".join(long)), (2, " ".join(rng.choices(vocabulary, k=60_000)))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make([t for _, t in docs])).collect()}
    gone = [x for k, x in enumerate(long) if x in base]
    assert got[0].n_removed == 0 and got[1].n_removed >= len(gone) and got[1].n_lines == 6000 and not set(got[1].text.split("\n")) & set(base)


def test_line_dedup_large_groups_name_enough():
    """For each line with an earlier one that passes, one that does is named; all are, or the line is said to have more."""
    import numpy as np

    rng = random.Random(9)
    for m, kinds in ((40, 1), (150, 3), (1500, 1)):
        rows = np.zeros((9, m), np.int64)
        rows[0] = sorted(rng.randrange(kinds) for _ in range(m))
        rows[1] = [rng.choice([rng.randint(5, 40), 230]) for _ in range(m)]
        rows[2] = rng.sample(range(m), m)
        rows[3] = rng.sample(range(m), m)
        rows[5] = [rng.getrandbits(4) for _ in range(m)]
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        a, b, more = line_dedup._named(rows, 0.8, 3)
        x = np.vstack([rows[1], rows[4:9], np.bitwise_xor.reduce(rows[5:9])])
        for j in range(m):
            before = np.flatnonzero((rows[0] == rows[0, j]) & (rows[2] < rows[2, j]))
            n, own = rows[1, before], rows[1, j]
            near = before[(n >= 0.8 * own - 1e-9) & (own >= 0.8 * n - 1e-9)]
            ok, _, sure = line_dedup._passes(x[:, near], np.repeat(x[:, [j]], len(near), axis=1), 0.8)
            want = set(near[ok].tolist())
            named = set(a[b == j].tolist())
            assert named <= want and bool(named) == bool(want)
            assert named == want or j in more
            assert not set(near[sure & ok].tolist()) or named & set(near[sure & ok].tolist())


def test_drop_repeats(spark, make, line_docs):
    docs = make([t for _, t in line_docs], [i for i, _ in line_docs])
    got = line_dedup.drop_repeats(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    want = {i: t for i, _, k, t in slow_lines(spark, line_docs) if not (k and not t.strip())}
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def slow_leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    wanted = {i: grams(words(t)) for i, t in items if len(words(t)) >= 5}
    df = {}
    for g in wanted.values():
        for x in set(g):
            df[x] = df.get(x, 0) + 1
    out = {}
    for d, t in docs:
        w = words(t)
        for i, g in wanted.items():
            n, best = len(g) + 4, 0
            total = sum(1 / df[x] for x in g)
            for s in range(max(1, len(w) - 4)):
                have = grams(w[s : s + n])
                best = max(best, sum(min(g.count(x), have.count(x)) / df[x] for x in set(g)) / total)
            if best >= 0.8 - 1e-9:
                out[d, i] = round(best, 9)
    return out


def test_leaks(make, spark, vocabulary):
    rng = random.Random(11)
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(say(rng.choice([12, 20, 35, 50])))) for i in range(12)] + [(12, "too short"), (13, None), (14, "")]
    items.append((15, items[0][1]))
    docs = [(0, None), (1, ""), (None, items[1][1]), (2, " ".join(say(200)))]
    for k in range(3, 60):
        w = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = say(1)
        docs.append((k, " ".join([*say(rng.randint(0, 60)), *w, *say(rng.randint(0, 60))]).upper().replace(" ", ", ")))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(make([t for _, t in docs], [d for d, _ in docs]), table)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()}
    assert got == slow_leaks(docs, items)
    clean = decontaminate.decontaminate(make([t for _, t in docs], [d for d, _ in docs]), table)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_leaks_of_items_with_a_template(make, spark, vocabulary):
    """A document may hold an item's own words without the template that all items begin with."""
    rng = random.Random(14)
    say = lambda n: rng.choices(vocabulary, k=n)
    head = say(40)
    own = [say(rng.choice([20, 24])) for _ in range(40)]
    items = [(i, " ".join(head + w)) for i, w in enumerate(own)]
    docs = [(k, " ".join([*say(90), *w, *say(30)])) for k, w in enumerate(own)] + [(100, " ".join(say(50) + head + say(50))), (101, items[0][1])]
    found = decontaminate.leaks(make([t for _, t in docs], [d for d, _ in docs]), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()}
    want = slow_leaks(docs, items)
    assert got == want and len(want) > 15


def test_decontaminate_takes_no_clean_row(make, spark, vocabulary):
    """Of rows with one id, or none, only those that leak go; a very long text is searched to its end."""
    rng = random.Random(18)
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = spark.createDataFrame([(1, say(30)), (2, say(12)), (3, say(900))], "item_id long, text string")
    bad, short, long = (r.text for r in items.orderBy("item_id").collect())
    far = say(9000) + " " + bad + " " + say(3000) + " " + short
    docs = [(1, bad), (1, say(40)), (None, "x " + bad), (None, say(20)), (None, None), (2, far), (2, far), (3, ""), (4, say(100) + " " + long), (5, say(6000))]
    table = make([t for _, t in docs], [i for i, _ in docs]).selectExpr("*", "1 _leak", "2 _x0", "3 h1", "4 `a.b`", "5 s")
    left = decontaminate.decontaminate(table, items)
    assert left.schema == table.schema
    want = [d for k, d in enumerate(docs) if k in (1, 3, 4, 7, 9)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)
    found = {(r.doc_id, r.item_id): (r.start_word, r.n_words) for r in decontaminate.leaks(table, items).collect()}
    assert found == {(1, 1): (0, 30), (None, 1): (1, 30), (2, 1): (9000, 30), (2, 2): (12030, 12), (4, 3): (100, 900)}


def test_blocks_name_what_is_near(spark):
    """SimHash in DataFrame functions equals a slow one; a bit counts by weight."""
    rng = random.Random(19)
    rows = [[(rng.getrandbits(64) - 2**63, rng.randint(1, 3), rng.choice([1.0, 0.5, 0.25])) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x array<struct<h:long,n:long,w:double>>")
    for r in table.select("k", decontaminate.simhash(F.col("x")).alias("p")).collect():
        got = sum(b << 16 * k for k, b in enumerate(r.p))
        assert got == sum(1 << b for b in range(64) if 2 * sum(n * w for h, n, w in rows[r.k] if h >> b & 1) > sum(n * w for _, n, w in rows[r.k]))


def test_leaks_of_an_item_without_an_id(make, spark):
    items = spark.createDataFrame([(None, "one two three four five six seven"), (1, "a b c d e f g h")], "item_id long, text string")
    found = decontaminate.leaks(make(["x one two three four five six seven y", "a b c d e f g h"]), items).collect()
    assert {(r.doc_id, r.item_id, r.start_word, r.similarity) for r in found} == {(0, None, 1, 1.0), (1, 1, 0, 1.0)}


def test_sharding(make, edge_texts, edge_ids):
    shards, slots = ("a", "b", "c", "d", "e"), 211
    table = sharding.lookup_table(shards, slots)
    counts = [table.count(k) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    want = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % slots
    got = sharding.shard(make(edge_texts, edge_ids), shards=shards, slots=slots)
    rows = got.collect()
    assert len(rows) == len(edge_ids) and got.columns == [*make([]).columns, "slot", "shard"]
    assert all(r.slot == want(r.doc_id) and r.shard == shards[table[r.slot]] for r in rows)
    clash = make(edge_texts, edge_ids).selectExpr("*", "1 _at", "2 _slot", "3 _shard", "4 k", "5 _x0", "6 `a.b`")
    assert sharding.shard(clash).columns == [*clash.columns, "slot", "shard"] and sharding.shard(clash).count() == len(edge_ids)
    fewer = sharding.lookup_table(shards[:4], slots)
    assert sum(a == b for a, b in zip(table, fewer) if a < 4) > 0.7 * sum(a < 4 for a in table)
    for bad in ((("a", "a"), 211), ((), 211), (("a",), 210)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_empty_tables(make, spark):
    none, items = make([]), spark.createDataFrame([], "item_id long, text string")
    assert simhash.op10(none).count() == exact_dedup.op4(none).count() == line_dedup.op5(none).count() == 0
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.decontaminate(make(["a b c d e f"]), items).count() == 1
    assert sharding.op2(none).count() == 0


def test_words_and_lines_of_buffers(edge_texts):
    import numpy as np
    import pyarrow as pa

    from paperloom.llm import bytewords

    column = pa.array(["skipped", *edge_texts, "", "\n", "a\n\nb\n"])[1:]
    seen, hashes = [], {}
    for rows, texts in bytewords.texts_of(column):
        data = texts.data.tobytes()
        s, e, h = texts.words()
        for a, b, x, d in zip(s, e, h, texts.text_of(s)):
            assert hashes.setdefault(data[a:b], x) == x
        text, number, begin, end = texts.lines()
        for d in range(rows.stop - rows.start):
            own = (column[rows.start + d].as_py() or "").encode().lower()
            assert [data[a:b] for a, b in zip(begin[text == d], end[text == d])] == own.split(b"\n") and number[text == d].tolist() == list(range(own.count(b"\n") + 1))
            at = texts.text_of(s) == d
            assert [data[a:b] for a, b in zip(s[at], e[at])] == own.split()
        seen += range(rows.start, rows.stop)
    assert seen == list(range(len(column))) and len(set(hashes.values())) == len(hashes)
    assert not np.any(bytewords.SPACE[[0x1C, 0xA0]])
