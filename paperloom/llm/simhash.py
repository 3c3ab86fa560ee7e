"""SimHash near-duplicates by covering locality-sensitive hashing (operator 10).

Fingerprints are 64 bits over word shingles. ``2**(radius + 1) - 1`` structured masks cover the radius: bit i carries a
non-zero vector m(i) of radius + 1 bits, and mask v keeps the bits whose vector has odd overlap with v. At most
``radius`` differing bits span at most ``radius`` dimensions, so some v is orthogonal to all of them; under that mask
the two fingerprints are equal. No pair within the radius is missed, and buckets are verified exactly.

Where a similarity is asked for, pairs lie too far apart for that. Then SimHash goes over the distinct shingles and has
``TABLES`` times 16 bits: texts that agree in ``BITS`` bits of some 16 meet in a bucket, are candidates if the first
``64 * WORDS`` bits differ in at most ``APART``, and the sets of shingles verify them.
"""

from __future__ import annotations

import itertools
import random
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import connected_components, first_of_equals, free_names, id_back, id_key, release_caches, text_key, written

#: Buckets with more fingerprints are compared in pairs of blocks of about this size, each pair a group of its own.
BLOCK = 8192
#: The same for sets of shingles, which are larger.
SETS = 1024
#: Of two sets with Jaccard 0.8 a bit differs with a probability of at most q = 0.1515 (0.162 where sets are small), so
#: they share no bucket with one of (1 - (1 - q)**BITS)**TABLES: 3 in ten million (3 in a million).
TABLES, BITS = 100, 12
#: Of 192 bits such a pair differs in 29, in over 56 with one of 3 in ten million (2 in a million); unrelated texts in 96.
WORDS, APART = 3, 56
#: Rows that are compared at a time in groups of up to SMALL rows.
ROWS, SMALL = 32768, 256
_FACTORS = np.array([x | 1 for x in map(random.Random(10).getrandbits, [64] * (TABLES // 4))], np.uint64)


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """64-bit hashes of the shingles of ``words`` words, one for each place; A-Z lower-cased, words split at ASCII white space. A shorter text is one shingle."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)


def _simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``words`` words; a text without a word has zero."""
    return _simhash(shingle_hashes(text, words))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(id_key(id_col).alias("id"), text_key(text).alias("h"), text.alias("text"))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, h long, fp long) for every row; a null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64)
            yield pa.record_batch([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["id", "h", "fp"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, h long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks as signed 64-bit values.

    The bits' vectors are dealt so that masks keep about half of the bits: those that keep few would have buckets that
    grow with the table. Where there are fewer vectors than bits each serves in turn; twice as many, those whose
    highest bit is set leave exactly half to every mask but one, which keeps all; beyond that they are drawn.
    """
    vectors = 2 ** (radius + 1) - 1
    if vectors <= bits:
        of_bit = [i % vectors + 1 for i in range(bits)]
    elif vectors == 2 * bits - 1:
        of_bit = [bits + i for i in range(bits)]
    else:
        of_bit = random.Random(radius).sample(range(1, vectors + 1), bits)
    masks = [sum(1 << i for i in range(bits) if (of_bit[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ, each a number or a row of numbers."""
    differ = np.bitwise_count(a ^ b)
    return differ if differ.ndim == 1 else differ.sum(axis=1)


def _stars(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each set of fingerprints linked within one bucket, edges from its first to the others. Exact; no pairs are kept."""
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = _apart(fps[left], fps[todo.pop()]) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                todo.extend(found.tolist())
                out.extend((int(reps[root]), int(x)) for x in reps[found])
    return out


def near_edges(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the ids of ``distinct`` (fp, rep) that link all fingerprints within ``radius`` bits, directly or through others."""
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))]))
    # each row becomes many, so a few small files must not make a few tasks
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.select("fp", "rep", tables.alias("x")).select("x.t", "x.k", "fp", "rep")
    # by far the most buckets have one fingerprint; a large one is dealt out before its rows meet
    shared = rows.groupBy("k", "t").agg(F.count("*").alias("n")).where("n > 1")
    # Spark counts the rows as if explode made no more of them: without a hint it would broadcast either side
    counted = rows.join(shared.hint("merge"), ["k", "t"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    dealt = counted.select("t", "k", "fp", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    dealt = dealt.select("t", "k", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "fp", "rep")
    key = ["k", "t", "i", "j"]
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in whole_groups(batches, ("k", "t", "i", "j", "fp", "rep"), 4):
            yield _edges_of(rows_, radius)

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[np.ndarray]:
    """Arrays of int64 columns that hold whole groups of rows equal in the first ``keys`` columns; the input is sorted by them."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in columns])
        last = np.flatnonzero((now[:keys] != now[:keys, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or (held and (held[-1][:keys, -1] != now[:keys, 0]).any()):
            if held or cut:
                yield np.concatenate([*held, now[:, :cut]], axis=1)
            held = []
        held.append(now[:, cut:])
    if held:
        yield np.concatenate(held, axis=1)


def _edges_of(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    """Groups of two, by far the most, in one go; larger ones each by itself."""
    fps, reps = rows[4].view(np.uint64), rows[5]
    starts = np.concatenate(([0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1))
    sizes = np.diff(np.append(starts, rows.shape[1]))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
    found = [np.stack([reps[two], reps[two + 1]], axis=1)]
    for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if edges := _stars(fps[a : a + n], reps[a : a + n], radius):
            found.append(np.array(edges, dtype=np.int64))
    edges = np.unique(np.concatenate(found), axis=0)
    return pa.record_batch([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["a", "b"])


def _set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a set of shingles, given in ascending order."""
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes())))[0]


def long_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of TABLES * 16 bits over distinct shingles, as numbers of 64 bits: each shingle has a hash of that length, a bit is 1 if set in over half of them."""
    ones = np.zeros(TABLES * 16, np.int64)
    for at in range(0, len(shingles), 255):  # so many fit in a byte
        x = shingles[at : at + 255, None] * _FACTORS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8").astype(np.uint64)


def buckets_of(shingles: np.ndarray, bits: np.ndarray) -> list[int]:
    """One bucket in each table by the bits of the long fingerprint; none for an empty set.

    Sums over four or five shingles are too coarse (a bit differs with a probability of 0.19): such sets also have
    buckets, negative ones, for every four of their shingles, as with Jaccard 0.8 they are equal or have four in common.
    """
    if not len(shingles):
        return []
    out = ((bits.astype("<u8").view("<u2") & (2**BITS - 1)) + (np.arange(TABLES) << BITS)).tolist()
    if len(shingles) in (4, 5):
        out += [_set_key(np.array(four, np.uint64)) % 2**31 - 2**31 for four in itertools.combinations(shingles.tolist(), 4)]
    return out


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp, key, p0.., buckets) for every row: the first WORDS numbers of the long fingerprint, and its buckets; equal sets of shingles have equal keys."""
    parts = [f"p{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            fps, keys, prints, buckets = [], [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), words)
                own = np.unique(hashes)
                bits = long_fingerprint(own)
                fps.append(_simhash(hashes))
                keys.append(_set_key(own))
                prints.append(bits[:WORDS])
                buckets.append(buckets_of(own, bits))
            first = np.array(prints, np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.int64()), *(pa.array(first[:, k].copy()) for k in range(WORDS)), pa.array(buckets, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, names=["id", "h", "fp", "key", *parts, "buckets"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"id long, h long, fp long, key long, {', '.join(f'{p} long' for p in parts)}, buckets array<int>")


def close_edges(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the keys of ``prints`` (key, p0.., buckets) that link all rows that share a bucket and differ in at most APART bits, directly or through others."""
    parts = [f"p{k}" for k in range(WORDS)]
    # rows of a negative bucket are candidates whatever their bits
    rows = prints.select("key", F.explode("buckets").alias("g"), *parts)
    rows = rows.select(F.col("g").cast("long").alias("g"), "key", *[F.when(F.col("g") < 0, F.lit(0).cast("long")).otherwise(F.col(p)).alias(p) for p in parts])
    crowded = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    met = rows.join(F.broadcast(crowded), "g", "left")
    # a bucket that is large is dealt out under a name for each pair of blocks; names that clash only meet more rows
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    dealt = met.select("g", "n", "key", *parts, own.alias("own"), other.alias("with"))
    name = F.when(F.col("n").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("own", "with"), F.greatest("own", "with")))
    sorted_ = dealt.select(name.alias("g"), "key", *parts).repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held: list[np.ndarray] = []
        for rows_ in itertools.chain(whole_groups(batches, ("g", "key", *parts), 1), [None]):
            if rows_ is not None:
                held.append(rows_)
            if held and (rows_ is None or sum(x.shape[1] for x in held) >= ROWS):
                yield _close_of(np.concatenate(held, axis=1))
                held = []

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _close_of(rows: np.ndarray) -> pa.RecordBatch:
    """Rows with none near them are most and go first, by comparing each with the one next to it, the one after that, and so on."""
    starts = np.concatenate(([0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1))
    sizes = np.diff(np.append(starts, rows.shape[1]))
    size = np.repeat(sizes, sizes)
    stay = size > SMALL
    small = rows[:, ~stay]
    near, prints = np.zeros(small.shape[1], bool), small[2:].view(np.uint64)
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        apart = np.bitwise_count(prints[:, d:] ^ prints[:, :-d]).sum(axis=0, dtype=np.uint8)
        hit = np.flatnonzero((apart <= APART) & (small[0, d:] == small[0, :-d]))
        near[hit] = near[hit + d] = True
    stay[np.flatnonzero(~stay)[near]] = True
    rows = rows[:, stay]
    edges = []
    if rows.shape[1]:
        starts = np.concatenate(([0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        two = starts[sizes == 2]
        two = two[_apart(rows[2:, two].T.view(np.uint64), rows[2:, two + 1].T.view(np.uint64)) <= APART]
        edges.append(np.stack([rows[1, two], rows[1, two + 1]], axis=1))
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if found := _stars(np.ascontiguousarray(rows[2:, a : a + n].T).view(np.uint64), rows[1, a : a + n], APART):
                edges.append(np.array(found, dtype=np.int64))
    out = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    return pa.record_batch([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["a", "b"])


def _spots(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _screen(members: DataFrame) -> np.ndarray:
    """2**22 bits that are set for all ids of ``members`` and maybe for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 22, bool)
        for batch in batches:
            seen[_spots(batch.column(0).to_numpy())] = True
        yield pa.record_batch([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["at"])

    out = np.zeros(1 << 22, bool)
    out[members.select("id").mapInArrow(run, "at int").distinct().toArrow()["at"].to_numpy()] = True
    return out


def set_edges(keys: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that link all sets with a Jaccard similarity of at least ``similarity``, directly or through others. Exact; no pairs are kept."""
    out, keys, n = [], np.array(keys, np.int64), np.array([len(s) for s in sets], np.int64)
    _, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), n)
    shared = often[flat] > 1  # others are in no intersection
    flat, of, places = flat[shared], of[shared], len(often)
    ends = np.cumsum(np.bincount(of, minlength=len(sets)))
    own = np.split(flat, ends[:-1])
    left, mark = np.ones(len(sets), bool), np.zeros(places, bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo and left.any():
            if left.sum() * 2 < len(np.unique(of)):
                flat, of = flat[left[of]], of[left[of]]
            x = todo.pop()
            mark[own[x]] = True
            both = np.bincount(of[mark[flat]], minlength=len(sets))
            mark[own[x]] = False
            found = np.flatnonzero(left & (both >= similarity * (n + n[x] - both) - 1e-9))
            left[found] = False
            todo.extend(found.tolist())
            out.extend((int(keys[root]), int(k)) for k in keys[found])
    return out


def similar_edges(docs: DataFrame, prints: DataFrame, distinct: DataFrame, words: int, similarity: float, id_col: str, text_col: str, block: int = SETS) -> DataFrame:
    """Edges (a, b) between the keys of ``distinct`` (key, rep) that link the sets of shingles with Jaccard ``similarity`` or more.

    Sets whose long fingerprints are close fall into one candidate component. Each component's sets then meet, large
    ones in pairs of blocks, and are compared exactly; the sets are made anew, as only candidates need them.
    """
    once = prints.groupBy("key").agg(*[F.first(c).alias(c) for c in prints.columns if c not in ("id", "h", "fp", "key")])
    rough = written(connected_components(close_edges(written(once, "once"))), "candidates")
    sizes = rough.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    members = rough.join(sizes, "component").withColumnRenamed("node", "key").join(distinct, "key")
    members = written(members.select("key", F.col("rep").alias("id"), "component", blocks.alias("blocks"), own.alias("own")), "members")
    spots = _screen(members)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            hit = batch.filter(pa.array(spots[_spots(batch.column(0).to_numpy())]))
            own_ = [np.unique(shingle_hashes(t.as_py(), words)) for t in hit.column(1)]
            yield pa.record_batch([hit.column(0), pa.array([_set_key(x) for x in own_], pa.int64()), pa.array([x.tobytes() for x in own_], pa.binary())], names=["id", "key", "shingles"])

    source = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = source.mapInArrow(sets, "id long, key long, shingles binary").join(members, ["id", "key"])
    dealt = met.select("component", "own", "key", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("component", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "key", "shingles")
    group = ["component", "i", "j"]
    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5))))
        for _, held in itertools.groupby(rows, key=lambda r: r[:3]):
            by_key = {r[3]: np.frombuffer(r[4], np.uint64) for r in held}
            if edges := set_edges(list(by_key), list(by_key.values()), similarity) if len(by_key) > 1 else []:
                yield pa.record_batch([pa.array([a for a, _ in edges]), pa.array([b for _, b in edges])], names=["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _classes(docs: DataFrame, radius: int, words: int, id_col: str, text_col: str, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """(id, h, fp, key) for every row, and (key, least) with the least (id, h) of the key's component."""
    if similarity is None:
        prints = written(fingerprints(docs, words, id_col, text_col).select("*", F.col("fp").alias("key")), "fingerprints")
    else:
        prints = written(sketches(docs, words, id_col, text_col), "sketches")
    # of a key only its least row takes part
    distinct = written(prints.groupBy("key").agg(F.min(F.struct("id", "h")).alias("least")).select("key", "least", F.col("least.id").alias("rep")), "distinct")
    if similarity is None:
        links = near_edges(distinct.select(F.col("key").alias("fp"), F.col("key").alias("rep")), radius)
    else:
        links = similar_edges(docs, prints, distinct.drop("least"), words, similarity, id_col, text_col)
    components = written(connected_components(links), "components")
    member = distinct.join(components, distinct.key == components.node, "left").select("key", "least", F.coalesce("component", "key").alias("c"))
    least = member.groupBy("c").agg(F.min("least").alias("least"))
    return prints.select("id", "h", "fp", "key"), written(member.drop("least").join(least, "c").select("key", "least"), "classes")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, fp long, component_id): the component is the smallest id reachable over links of at most ``radius`` bits.

    With ``similarity`` the links are instead between texts whose sets of shingles have that Jaccard similarity or more,
    checked exactly. Candidates are found by a longer SimHash than the one returned; a pair at 0.8 is missed with a
    probability of at most 5 in a million, by calculation.

    Null and blank texts share fingerprint zero and are linked like any other; a null id sorts before all others and
    stays null (-2**63 counts as null); rows that repeat an id each keep their own fingerprint and row; fingerprints
    are of whole texts, of any length; an empty table gives an empty one. Other columns are not looked at.
    """
    prints, classes = _classes(docs, radius, words, id_col, text_col, similarity)
    return prints.join(classes, "key").select(id_back("id").alias("doc_id"), "fp", id_back("least.id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 4, words: int = 5, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``docs`` without the near copies, columns unchanged: of each component of ``near_duplicates`` one row stays.

    It is the one with the smallest id, null first; where rows repeat that id, the one whose text has the smallest hash;
    of rows equal in both any one. Null and blank texts are copies of each other; a row that shares no more than its id
    with a row that goes stays. An empty table gives an empty one; columns may have any names.
    """
    prints, classes = _classes(docs, radius, words, id_col, text_col, similarity)
    id_, h, again = free_names(docs.columns, 3)
    gone = prints.join(classes, "key").where((F.col("id") != F.col("least.id")) | (F.col("h") != F.col("least.h")))
    gone = written(gone.select(F.col("id").alias(id_), F.col("h").alias(h)).distinct(), "gone")
    rows = docs.withColumns({id_: id_key(id_col), h: text_key(F.col(text_col).cast("string"))})
    left = first_of_equals(rows, [id_, h], again).join(gone, [id_, h], "left_anti")
    return left.where(~F.col(again)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
