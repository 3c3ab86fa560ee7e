"""Line dedup by an exact set-similarity join (operator 5).

A line is the set of its words, split at ASCII white space, with A-Z lower-cased. Two lines match when the Jaccard
similarity of their sets is at least the threshold t. A line goes when any line before it matches. Lines are ordered by
document id, then, where rows repeat an id, by a hash of the text, then by line number.

Words are ordered by rarity. A pair with Jaccard t or more shares a word among the first n - ceil(t n) + 1 of both
(prefix filter), has lengths within a factor of t (length filter), has enough words left after the first shared one
(positional filter) and differs in at most (m + n)(1 - t)/(1 + t) words; a 64-bit parity of hashed words never differs
in more bits than that. Pairs that pass are verified word by word.

Words are counted exactly, those of one slot of their hash together. The logarithms of the counts of the FREQUENT most
frequent slots go to all tasks; all others count as rare. Every line uses the same order, so no pair is lost however good
it is. A word that occurs once in all texts is shared by no two lines: it keeps its place, but no line is named by it.
"""

from __future__ import annotations

import itertools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bytewords import Texts, texts_of
from paperloom.llm.common import first_of_equals, free_names, id_key, release_caches, text_key, worker_cache, written

SIMILARITY, LEAST = 0.8, 1
#: Words are counted and ranked by slots of their hash; so many slots' ranks are sent to all tasks, a byte each.
FREQUENT, SLOTS = 1 << 20, 1 << 24
#: Words that a task holds before it adds them to its counts.
COUNTED = 1 << 21
#: A word that is in the prefix of more lines has them compared in pairs of blocks, each pair a group of its own.
BLOCK = 16_384
#: Lines of more words have a signature of two or four times 64 bits.
TWO, FOUR = 100, 200
#: Earlier lines named for a line by one word, those with the nearest signatures; one is enough where it is near enough
#: to be all but sure. If none of them matches and there were more, all are looked at.
NAMED = 4
#: So many lines at most have their documents' ids broadcast, so that other texts are passed over.
FEW = 1 << 19
#: Lines that a task remembers so as not to send them again; then it forgets all and goes on.
REMEMBERED = 200_000


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(id_key(id_col).alias("id"), text_key(text).alias("h"), text.alias("text")).where("text is not null")


def word_counts(source: DataFrame) -> DataFrame:
    """(part, levels): for each slot of the words' hashes, in the order of parts, the level of how often its words occur in ``source``, 0 for once or never; compressed.

    A task counts by slot and sends sorted slots and counts in one piece for each part of their range, not as rows.
    """
    parts = min(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), SLOTS)
    bounds = np.array([-(-k * SLOTS // parts) for k in range(parts + 1)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        total, held, size = np.zeros(SLOTS, np.uint32), [], 0

        def add() -> None:
            slots = np.concatenate(held)
            slots.sort()
            at = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
            total[slots[at]] += np.diff(np.append(at, len(slots))).astype(np.uint32)

        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                held.append((texts.words()[2] >> np.uint64(40)).astype(np.uint32))
                size += len(held[-1])
                if size > COUNTED:
                    add()
                    held, size = [], 0
        if size:
            add()
        slots = np.flatnonzero(total).astype(np.uint32)
        cut = np.searchsorted(slots, bounds[1:-1])
        yield pa.record_batch([pa.array(range(parts), pa.int32()), *(pa.array([x.tobytes() for x in np.split(c, cut)], pa.binary()) for c in (slots, total[slots]))], names=["part", "slots", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part not in totals:
                    totals[part] = np.zeros(bounds[part + 1] - bounds[part], np.int64)
                totals[part][np.frombuffer(slots.as_buffer(), np.uint32) - bounds[part]] += np.frombuffer(n.as_buffer(), np.uint32)
        levels = [zlib.compress(np.where(n > 1, level(np.maximum(n, 1)), 0).astype(np.uint8).tobytes(), 1) for n in totals.values()]
        yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], names=["part", "levels"])

    return source.select("text").mapInArrow(count, "part int, slots binary, n binary").repartition(parts, "part").mapInArrow(summed, "part int, levels binary")


def level(n: np.ndarray | int) -> np.ndarray:
    """Eight times the binary logarithm of a count, a byte."""
    return np.minimum(np.floor(np.log2(n) * 8 + 1e-9), 255).astype(np.uint8)


def rarity(source: DataFrame, frequent: int = FREQUENT) -> tuple[bytes, int]:
    """For each slot of a word's hash the level of its count for the ``frequent`` most frequent slots, 1 for others met twice or more, 0 for those met once, compressed; and the least level that has all its slots in it."""
    counted = sorted(word_counts(source).toArrow().to_pylist(), key=lambda r: r["part"])
    table = np.frombuffer(b"".join(zlib.decompress(r["levels"]) for r in counted), np.uint8)
    table = table if len(table) else np.zeros(SLOTS, np.uint8)
    sizes, least, total = np.bincount(table, minlength=256), 256, 0
    for k in np.flatnonzero(sizes[1:])[::-1] + 1:
        total += sizes[k]
        if total > frequent:
            break
        least = int(k)
    return zlib.compress(np.where(table >= least, table, table > 0).astype(np.uint8).tobytes(), 1), least


_tables: dict[int, np.ndarray] = worker_cache({})


def _ranks(packed: bytes) -> np.ndarray:
    key = zlib.crc32(packed)
    if key not in _tables:
        _tables.clear()
        _tables[key] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return _tables[key]


def prefix_length(n: np.ndarray, t: float = SIMILARITY) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


LINE = ("id", "h", "line")
#: How lines travel by their keys, and how the first of equal ones are kept: many in one piece, the words of their
#: prefixes, ``size`` for each, in a piece beside it. These are 32-bit hashes, rarest first, but for the ``skip`` first
#: that occur nowhere else; the last ``common`` may be in more than BLOCK lines.
RECORD = np.dtype([("key", "<u8", 2), ("id", "<i8"), ("h", "<i8"), ("line", "<i4"), ("n", "<i4"), ("skip", "<i4"), ("size", "<i4"), ("common", "<i4"), ("sig", "<i8", 4)])
FIRST = np.dtype([("lid", "<i8"), *((x, RECORD[x]) for x in ("id", "n", "skip", "size"))] + [("sig", "<i8", 4)])
GONE = np.dtype([("id", "<i8"), ("h", "<i8"), ("line", "<i4")])
LINES = "lines binary, tokens binary, gone binary, common array<int>, n long"
#: Lines in one piece.
PIECE = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _lid(ids: np.ndarray, hs: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Numbers for lines: 64-bit hashes of (id, h, line), which those of one text never share. Texts are looked up by them, so two lines with one number would have a few pairs more verified."""
    text = _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hs.astype(np.int64).view(np.uint64))
    return _mixed(text + lines.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _spans(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs of ``sizes`` that end before ``ends``, end to end."""
    return np.arange(sizes.sum()) + np.repeat(ends - np.cumsum(sizes), sizes)


def _taken(rows: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` and their tokens."""
    return rows[at], tokens[_spans(np.cumsum(rows["size"], dtype=np.int64)[at], rows["size"][at].astype(np.int64))]


def distinct_lines(source: DataFrame, ranks: bytes, known: int, t: float, least: int) -> DataFrame:
    """LINES: in ``lines`` the first of equal lines of at least ``least`` distinct words, as FIRST, with the words of their prefixes in ``tokens``; in ``gone`` the others, as GONE.

    Of equal lines in a task those before all met so far are sent by their keys, and those that go, with n = 0.
    ``common`` holds the words that may be in more than BLOCK lines: frequent ones, or all where the counts of some such
    words are not ``known``; ``n`` is the number of tokens.
    """
    high = int(level(BLOCK)) if known <= level(BLOCK) else 0
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        table = _ranks(ranks)
        first: dict[bytes, tuple[int, int, int]] = {}
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            rows, tokens = (np.concatenate(x) for x in zip(*held))
            part = ((rows["key"][:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            rows, tokens = _taken(rows, tokens, order)
            present, at = np.unique(part[order], return_index=True)
            ends = np.append(0, np.cumsum(rows["size"], dtype=np.int64))[np.append(at, len(rows))]
            pieces = [[x[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())] for x, cuts in ((rows, np.append(at, len(rows))), (tokens, ends))]
            return pa.record_batch([pa.array(present.astype(np.int32)), *(pa.array(x, pa.binary()) for x in pieces)], names=["part", "rows", "tokens"])

        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, texts in texts_of(batch.column(2)):
                held.append(_lines_of(ids[rows], hs[rows], texts, first, table, high, t, least))
                size += len(held[-1][0]) + len(held[-1][1])
                if len(first) > REMEMBERED:
                    first.clear()
                if size > 4 * SENT:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        pieces = ((p, r, w) for b in batches for p, r, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2)))
        for _, group in itertools.groupby(pieces, key=lambda x: x[0]):
            rows, tokens = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in c]) for c, k in zip(list(zip(*group))[1:], (RECORD, np.uint32)))
            order = np.flatnonzero(rows["n"])
            order = order[np.lexsort([c[order] for c in (rows["line"], rows["h"], rows["id"], rows["key"][:, 1], rows["key"][:, 0])])]
            key = rows["key"][order]
            new = np.append(True, (key[1:] != key[:-1]).any(axis=1))[: len(order)]
            head = order[new][np.cumsum(new) - 1]
            # a row stored twice has each of its lines twice, at the same place: these stay or go together
            later = np.logical_or.reduce([rows[x][order] != rows[x][head] for x in LINE])
            gone = rows[np.append(np.flatnonzero(rows["n"] == 0), order[later])]
            out = np.zeros(len(gone), GONE)
            for x in LINE:
                out[x] = gone[x]
            firsts, tokens = _taken(rows, tokens, np.sort(order[new]))
            lines = np.zeros(len(firsts), FIRST)
            lines["lid"] = _lid(*(firsts[x] for x in LINE))
            for x in ("id", "n", "skip", "size", "sig"):
                lines[x] = firsts[x]
            ends = np.append(0, np.cumsum(lines["size"], dtype=np.int64))
            for at in range(0, max(len(lines), 1), PIECE):
                to = min(at + PIECE, len(lines))
                own = tokens[ends[at] : ends[to]]
                common = own[_spans(ends[at + 1 : to + 1] - ends[at], firsts["common"][at:to].astype(np.int64))]
                columns = [[x.tobytes()] for x in (lines[at:to], own, out if at == 0 else out[:0])]
                yield pa.record_batch([*(pa.array(x, pa.binary()) for x in columns), pa.array([common.view(np.int32)], pa.list_(pa.int32())), pa.array([len(own)])], names=[x.split()[0] for x in LINES.split(", ")])

    sent = source.mapInArrow(run, "part int, rows binary, tokens binary").repartition(parts, "part").sortWithinPartitions("part")
    return sent.mapInArrow(ranked, LINES)


def _gone(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0):
                rows = np.frombuffer(piece.as_buffer(), GONE)
                yield pa.record_batch([pa.array(np.ascontiguousarray(rows[x])) for x in LINE], names=[*LINE])

    return lines.select("gone").mapInArrow(run, "id long, h long, line int")


def _lines_of(ids: np.ndarray, hs: np.ndarray, texts: Texts, first: dict[bytes, tuple[int, int, int]], ranks: np.ndarray, high: int, t: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    text, number, begin, end = texts.lines()
    s, _, h = texts.words()
    line = np.repeat(np.arange(len(begin)), np.diff(np.append(np.searchsorted(s, begin), len(s))))
    enough = np.bincount(line, minlength=len(text)) >= least
    if least > 1:  # words may repeat
        pairs = np.unique(np.stack([line[enough[line]].astype(np.uint64), h[enough[line]]]), axis=1)
        enough = np.bincount(pairs[0].astype(np.int64), minlength=len(text)) >= least
    data, keep, keys, gone = texts.data.tobytes(), np.zeros(len(text), bool), [], []
    digest = xxhash.xxh3_128_digest
    at = np.flatnonzero(enough)
    for g, a, b, i, x, k in zip(at.tolist(), begin[at].tolist(), end[at].tolist(), ids[text[at]].tolist(), hs[text[at]].tolist(), number[at].tolist()):
        key, here = digest(data[a:b]), (i, x, k)
        if (old := first.get(key)) is None or here < old:
            first[key] = here
            keep[g] = True
            keys.append(key)
        elif old < here:
            gone.append(g)
    kept = np.flatnonzero(keep)
    new = np.cumsum(keep) - 1
    own = keep[line]
    # a line's number and 50 bits of a word's hash are one integer to sort by
    where, h = new[line[own]], h[own] >> np.uint64(14)
    pieces = []
    for lo in range(0, max(len(kept), 1), 1 << 14):
        a, b = np.searchsorted(where, [lo, lo + (1 << 14)])
        pieces.append(_prefixes(where[a:b] - lo, h[a:b], min(len(kept) - lo, 1 << 14), ranks, t))
    n, skip, sig, sizes, tokens, rank = (np.concatenate(x, axis=-1) for x in zip(*pieces))
    at, m = np.concatenate([kept, np.array(gone, np.int64)]), len(kept)
    rows = np.zeros(len(at), RECORD)
    rows["id"], rows["h"], rows["line"] = ids[text[at]], hs[text[at]], number[at]
    rows["key"][:m] = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    rows["key"][m:, 0] = _lid(*(rows[x][m:] for x in LINE)).view(np.uint64)
    often = np.append(0, np.cumsum(rank >= high))[np.append(0, np.cumsum(sizes))]
    for x, values in (("n", n), ("skip", skip), ("size", sizes), ("common", np.diff(often)), ("sig", sig.view(np.int64).T)):
        rows[x][:m] = values
    return rows, tokens.astype(np.uint32)


def _prefixes(line: np.ndarray, h: np.ndarray, lines: int, ranks: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """For each line its distinct words, how many of the prefix occur nowhere else, signature and number of the prefix's others; and these and their ranks.

    ``h`` has 50 bits; ``line`` ascends and is less than 2**14.
    """
    key = np.sort((line.astype(np.uint64) << np.uint64(50)) | h)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    h = key & np.uint64((1 << 50) - 1)
    line = (key >> np.uint64(50)).astype(np.int64)
    n = np.bincount(line, minlength=lines)
    starts = np.cumsum(n) - n
    sig = np.zeros((4, lines), np.uint64)
    if len(h):
        words = np.repeat(np.select([n > FOUR, n > TWO], [3, 1]), n).astype(np.uint64)  # of a line's signature, less one
        of, bit = (h >> np.uint64(42)) & words, np.uint64(1) << (h >> np.uint64(44))
        for k in range(4 if words.any() else 1):
            sig[k, n > 0] = np.bitwise_xor.reduceat(np.where(of == k, bit, np.uint64(0)), starts[n > 0])
    rank = ranks[(h >> np.uint64(26)).astype(np.int64)].astype(np.uint64)
    order = np.sort((line.astype(np.uint64) << np.uint64(50)) | (rank << np.uint64(32)) | (h & np.uint64(2**32 - 1)))
    size = prefix_length(n, t)
    size[n == 0] = 0
    order = order[(np.arange(len(order)) - np.repeat(starts, n)) < np.repeat(size, n)]
    rank = (order >> np.uint64(32)) & np.uint64(255)
    skip = np.bincount((order[rank == 0] >> np.uint64(50)).astype(np.int64), minlength=lines)
    return n, skip, sig, size - skip, order[rank > 0] & np.uint64(2**32 - 1), rank[rank > 0]


def _sure(most: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Bits that sets differing in half as many words as they may do show on average; half the bits differ where the sets have nothing in common."""
    return np.minimum(bits / 2 * (1 - np.exp(-most / bits)), 0.28 * bits)


#: Rows of a group of candidates, by size in each. ``lid`` is a number for a line that has no order, ``asked`` may be left out.
GROUP = ("key", "n", "id", "lid", "place", "s0", "s1", "s2", "s3", "asked")


def _passes(a: np.ndarray, b: np.ndarray, t: float, i: np.ndarray | slice = slice(None), j: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature filter for pairs of lines (columns n, place, s0 to s3, all four in one): what passes, how many bits differ for each that may, and whether so few that a match is all but sure.

    The pairs are those of ``i`` in ``a`` with ``j`` in ``b``; s0 to s3 are looked at for long lines only.
    """
    n, m = a[0][i], b[0][j]
    most = (n + m) * ((1 - t) / (1 + t)) + 1e-9
    differ = np.bitwise_count((a[6][i] ^ b[6][j]).view(np.uint64)).astype(np.float64)
    ok, sure = differ <= most, differ <= _sure(most, 64)
    long = np.flatnonzero(ok & (np.minimum(n, m) > TWO))
    if len(long):
        one, other = (np.arange(len(x[0]))[k][long] for x, k in ((a, i), (b, j)))
        x, four = (a[2:6, one] ^ b[2:6, other]).view(np.uint64), np.minimum(n, m)[long] > FOUR
        differ[long] = np.bitwise_count(np.where(four, x, np.stack([x[0] ^ x[2], x[1] ^ x[3], 0 * x[0], 0 * x[0]]))).sum(axis=0)
        ok[long] = differ[long] <= most[long]
        sure[long] = differ[long] <= _sure(most[long], np.where(four, 256, 128))
    return ok, differ / most, sure & ok


def _nearest(pairs: list[np.ndarray], near: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (earlier, later, sure) those to name: for a later one its nearest sure one, else its ``most`` nearest."""
    a, near_ = np.concatenate(pairs, axis=1), np.concatenate(near)
    order = np.lexsort((near_, 1 - a[2], a[1]))
    a, near_ = a[:, order], near_[order]
    starts = np.flatnonzero(np.append(True, a[1, 1:] != a[1, :-1])) if a.shape[1] else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, a.shape[1]))
    turn = np.arange(a.shape[1]) - np.repeat(starts, sizes)
    keep = turn < np.repeat(np.where(a[2, starts] == 1, 1, most), sizes)
    return a[:, keep], near_[keep]


def _named(rows: list[np.ndarray], t: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of whole groups (columns GROUP): pairs (earlier, later) to verify and the later ones that have more.

    Lines of one id may be either. With ``asked`` only rows where it is true are looked at as later ones, and none is
    sure: such have been verified in vain.
    """
    size, all_ = len(rows[0]), len(rows) < len(GROUP)
    group = np.cumsum(np.append(0, rows[0][1:] != rows[0][:-1]))
    n, ids, lids = rows[1].astype(np.int64), rows[2], rows[3]
    left, x = n - rows[4] - 1, np.vstack([n, *rows[4:9], rows[5] ^ rows[6] ^ rows[7] ^ rows[8]])
    wanted = np.ones(size, bool) if all_ else rows[9].astype(bool)
    share, count = t / (1 + t), np.zeros(size, np.int64)
    # the length filter, and the positional filter for the shorter line's place
    reach = np.clip(np.floor(np.minimum(n / t, (1 + left) / share - n) + 1e-6).astype(np.int64), 0, 2**31 - 1)
    last = np.searchsorted((group << 32) | n, (group << 32) | reach, "right") - 1
    pairs, near, held = [np.zeros((3, 0), np.int64)], [np.zeros(0)], 0
    a, d, untouched = np.arange(size), 1, all_
    while len(a := a[last[a] >= a + d]):
        i = a if untouched else a[wanted[a] | wanted[a + d]]
        i = i[1 + np.minimum(left[i], left[i + d]) >= (n[i] + n[i + d]) * share - 1e-9]
        if len(i):
            ok, close, sure = _passes(x, x, t, i, i + d)
            i, close, sure = i[ok], close[ok], sure[ok] & all_
            j = i + d
            two = lids[i] != lids[j]  # hashes of two words of a line may be equal
            one, other = two & (ids[i] <= ids[j]) & wanted[j], two & (ids[i] >= ids[j]) & wanted[i]
            e, f = np.append(i[one], j[other]), np.append(j[one], i[other])
            if len(f):
                count += np.bincount(f, minlength=size)
            pairs.append(np.stack([e, f, np.append(sure[one], sure[other])]))
            near.append(np.append(close[one], close[other]))
            held += len(e)
            if held > 250_000:
                named, close = _nearest(pairs, near, most)
                pairs, near, held = [named], [close], 0
                # what lies further on isn't looked at for those that have a sure one
                done = named[1, (named[2] == 1) & (ids[named[0]] != ids[named[1]])]
                count[done] += 1
                wanted[done] = False
                untouched = untouched and not len(done)
        d += 1
    (e, f, _), _ = _nearest(pairs, near, most)
    return e, f, np.flatnonzero(count > np.bincount(f, minlength=size))


CANDIDATES = "a long, b long, a_id long, b_id long, more int"


def _blocks(lines: DataFrame, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that are in the prefix of more than ``block`` lines, in order, and for each how many blocks these make."""
    often = lines.select(F.explode("common").alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") > block).toArrow()
    words, n = often["tok"].to_numpy().astype(np.int32).view(np.uint32), often["n"].to_numpy()
    order = np.argsort(words)
    return words[order], -(-n[order] // block)


def _in_blocks(tokens: np.ndarray, lids: np.ndarray, words: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``tokens`` (of lines ``lids``) to send, and their groups: for one of ``words`` the pairs of blocks that its line's is in."""
    at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    split = words[at] == tokens
    times = np.where(split, blocks[at], 1)
    of = np.repeat(np.arange(len(tokens)), times)
    other = (np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    own = _mixed(lids.view(np.uint64))[of] % times[of].astype(np.uint64)
    pair = _mixed(tokens[of].astype(np.uint64) << np.uint64(32) ^ _mixed((np.minimum(own, other) << np.uint64(32)) + np.maximum(own, other)))
    return of, np.where(split[of], (pair >> np.uint64(32)).astype(np.uint32), tokens[of])


#: How the columns GROUP travel, many rows in one piece.
KINDS = ("<u4", "<i4", "<i8", "<i8", "<i4", "<i8", "<i8", "<i8", "<i8", "<i1")
#: Rows that a task holds before it sends them, and that a part is to have.
SENT = 200_000


def candidates(lines: DataFrame, often: tuple[np.ndarray, np.ndarray], t: float, most: int, asked: DataFrame | None = None) -> DataFrame:
    """(a, b, a_id, b_id, more): lids and ids of lines that may match, b the later one unless both have one id; with null a the group ``more`` where some may be left out for b.

    ``lines`` as by ``distinct_lines``, ``often`` as by ``_blocks``. With ``asked`` (lid, more) as later ones for those
    lines in those groups only, and maybe a few others, as both are known by a screen.
    """
    again = asked is not None
    total = lines.agg(F.sum("n")).first()[0] or 0
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // SENT)
    narrow = np.uint16 if parts < 1 << 16 else np.uint32  # of 16 bits a stable sort is by radix
    if again:  # few rows are sent
        parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 8)
    screens = [_screen(asked.select(x.cast("int").alias("at"))) for x in (F.shiftrightunsigned("lid", 40), F.shiftrightunsigned("more", 8))] if again else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held, size = [], 0
        wanted, groups = map(_unpacked, screens) if again else (None, None)

        def sent() -> pa.RecordBatch:
            rows, token = (np.concatenate(c) for c in zip(*held))
            sizes = rows["size"].astype(np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = rows["skip"][of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if len(often[0]):
                at, token = _in_blocks(token, rows["lid"][of], *often)
                of, place = of[at], place[at]
            if again:
                hit = np.flatnonzero(groups[token >> np.uint32(8)])
                of, token, place = of[hit], token[hit], place[hit]
            part = (token.astype(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(2**32) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part.astype(narrow), kind="stable")
            of = of[order]
            asked_ = wanted[_spot(rows["lid"])] if again else np.ones(len(rows), bool)
            sig = np.ascontiguousarray(rows["sig"].T)
            columns = [token[order], *(rows[x].astype(k)[of] for x, k in zip(GROUP[1:4], KINDS[1:])), place[order].astype(KINDS[4]), *(x[of] for x in sig), asked_.astype(KINDS[9])[of]]
            present, at = np.unique(part[order], return_index=True)
            pieces = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)])]
            return pa.record_batch([pa.array(present.astype(np.int32)), pa.array(pieces, pa.binary())], names=["part", "rows"])

        for batch in batches:
            for piece in _pieces(batch):
                held.append(piece)
                size += len(piece[1])
                if size > SENT:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        pieces = ((p, r) for b in batches for p, r in zip(b.column(0).to_pylist(), b.column(1)))
        width = sum(np.dtype(k).itemsize for k in KINDS)
        for _, group in itertools.groupby(pieces, key=lambda x: x[0]):
            columns = [[] for _ in KINDS]
            for _, piece in group:
                data, at = piece.as_buffer(), 0
                n = len(data) // width
                for c, k in zip(columns, KINDS):
                    c.append(np.frombuffer(data, k, n, at))
                    at += n * np.dtype(k).itemsize
            rows = [np.concatenate(c) for c in columns]
            del columns
            order = np.argsort((rows[0].astype(np.int64) << 32) | rows[1])
            rows = [c[order] for c in (rows if again else rows[:9])]
            e, f, more = _named(rows, t, most)
            earlier = [pa.concat_arrays([pa.array(x[e]), pa.nulls(len(more), pa.int64())]) for x in (rows[3], rows[2])]
            later = [pa.array(np.append(x[f], x[more])) for x in (rows[3], rows[2])]
            groups = pa.concat_arrays([pa.nulls(len(e), pa.int32()), pa.array(rows[0][more].view(np.int32))])
            yield pa.record_batch([earlier[0], later[0], earlier[1], later[1], groups], names=["a", "b", "a_id", "b_id", "more"])

    dealt = lines.select("lines", "tokens").mapInArrow(deal, "part int, rows binary").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, CANDIDATES).distinct()


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, tokens in zip(batch.column(0), batch.column(1)):
        yield np.frombuffer(rows.as_buffer(), FIRST), np.frombuffer(tokens.as_buffer(), np.uint32)


def _spot(lids: np.ndarray) -> np.ndarray:
    return (lids.view(np.uint64) >> np.uint64(40)).astype(np.int64)


def _screen(spots: DataFrame) -> bytes:
    """2**24 bits, compressed, that are set at ``spots`` (at). It only saves moving lines that nothing asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 24, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = True
        yield pa.record_batch([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["at"])

    out = np.zeros(1 << 24, bool)
    out[spots.mapInArrow(run, "at int").distinct().toArrow()["at"].to_numpy()] = True
    return zlib.compress(np.packbits(out).tobytes(), 1)


def _unpacked(screen: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(screen), np.uint8)).astype(bool)


def matched(source: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(lid, id, h, line) of the lines b in ``pairs`` (a, b, a_id, b_id) whose line a does match, word by word, and comes before."""
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("lid"), F.col(f"{x}_id").alias("id")) for x in "ab")))
    named = written(pairs.select(ends.alias("end")).select("end.*").distinct(), "named")
    screen = _screen(named.select(F.shiftrightunsigned("lid", 40).cast("int").alias("at")))
    if named.count() <= FEW:
        source = source.join(F.broadcast(named.select("id").distinct()), "id", "left_semi")

    def texts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        wanted = _unpacked(screen)
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, texts in texts_of(batch.column(2)):
                text, number, begin, end = texts.lines()
                lid = _lid(ids[rows][text], hs[rows][text], number)
                hit = np.flatnonzero(wanted[_spot(lid)])
                data = texts.data.tobytes()
                content = [data[a:b] for a, b in zip(begin[hit].tolist(), end[hit].tolist())]
                of = text[hit]
                yield pa.record_batch([pa.array(lid[hit]), pa.array(ids[rows][of]), pa.array(hs[rows][of]), pa.array(number[hit].astype(np.int32)), pa.array(content, pa.binary())], names=["lid", *LINE, "text"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            ok, last, one = np.zeros(batch.num_rows, bool), None, frozenset()
            for k, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if a != last:
                    last, one = a, frozenset(a.split())
                other = set(b.split())
                both = len(one & other)
                ok[k] = both / (len(one) + len(other) - both) >= t - 1e-9
            yield pa.record_batch([c.filter(pa.array(ok)) for c in batch.columns[:4]], names=["lid", *LINE])

    # rows stored twice give their lines twice, which does no harm
    found = written(source.mapInArrow(texts_of_lines, "lid long, id long, h long, line int, text binary").join(named.select("lid").distinct(), "lid", "left_semi"), "texts")
    later = found.select(F.col("lid").alias("b"), F.struct(*LINE).alias("at"), "text")
    earlier = found.select(F.col("lid").alias("a"), F.struct(*LINE).alias("a_at"), F.col("text").alias("a_text"))
    both = pairs.select("a", "b").join(later, "b").join(earlier, "a").where(F.col("a_at") < F.col("at"))
    return both.select("b", "at.*", "a_text", "text").mapInArrow(verified, "lid long, id long, h long, line int").distinct()


def later_matches(docs: DataFrame, t: float = SIMILARITY, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, line) of every line that goes: id as ``id_key`` gives it, h as ``text_key`` does. Rows equal in both are one here."""
    source = _source(docs, id_col, text_col)
    lines = written(distinct_lines(source, *rarity(source), t, least), "lines")
    gone, asked, most, often = _gone(lines), None, NAMED, _blocks(lines, BLOCK)
    while True:
        named = written(candidates(lines, often, t, most, asked), "candidates")
        found = written(matched(source, named.where("a is not null").drop("more"), t), "matched")
        gone = gone.union(found.select(*LINE))
        asked = written(named.where("a is null").select(F.col("b").alias("lid"), "more").join(found, "lid", "left_anti"), "unsure")
        if asked.isEmpty():
            return gone
        most *= 256


def dedup_lines(docs: DataFrame, t: float = SIMILARITY, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later matches taken out of the text, and columns n_lines and n_removed (replaced if there).

    Lines end at line feeds; lines of fewer than ``least`` distinct words, always those without a word, stay. Every row
    stays, also one whose text is now empty; a null text stays null and has no lines, an empty one has one, which
    stays. Null ids come first. Rows that repeat an id, null ones too, are documents of their own, in the order of a
    hash of their texts; of rows equal in id and text one comes before the others, which lose all their lines of enough
    words. Ties in nothing else are possible, as lines have numbers. A text is held whole by one task; its lines are
    dealt out by their words. An empty table gives an empty one. Other columns, whatever their names, are passed through.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    id_, h, gone, again = free_names(docs.columns, 4)
    text = F.col(text_col).cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], id_key(id_col).alias(id_), text_key(text).alias(h))
    lines = later_matches(docs, t, least, id_col, text_col).groupBy("id", "h").agg(F.collect_set("line").alias(gone))
    lines = written(lines.withColumnsRenamed({"id": id_, "h": h}), "gone")
    joined = first_of_equals(rows, [id_, h], again).join(lines.hint("shuffle_hash"), [id_, h], "left")
    all_ = F.split(text, "\n")
    low = lambda x: F.translate(x, string.ascii_uppercase, string.ascii_lowercase)
    words = lambda x: F.size(F.array_distinct(F.filter(F.split(low(x), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    repeats = F.filter(F.transform(all_, lambda x, i: F.when(words(x) >= max(least, 1), i)), lambda i: i.isNotNull())
    out = F.when(F.col(again), repeats).otherwise(F.coalesce(gone, F.array().cast("array<int>")))
    joined = joined.withColumn(gone, F.when(F.col(text_col).isNotNull(), out))
    kept = F.when(F.size(gone) > 0, F.array_join(F.filter(all_, lambda x, i: ~F.array_contains(gone, i)), "\n")).otherwise(text)
    columns = [kept.cast(docs.schema[text_col].dataType).alias(c) if c == text_col else F.col(f"`{c}`") for c in rest]
    return joined.select(*columns, F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), F.greatest(F.lit(0), F.size(F.coalesce(gone, F.array().cast("array<int>")))).alias("n_removed"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the later matches taken out as by ``dedup_lines`` and ``chars_col``, if there, counted anew; rows left without a word by that go.

    Null, empty and blank texts stay as they are; columns keep their names, types and order.
    """
    lines, removed = free_names(docs.columns, 2)
    found = dedup_lines(docs.withColumnsRenamed({"n_lines": lines, "n_removed": removed}), id_col=id_col, text_col=text_col).where(~((F.col("n_removed") > 0) & ~F.col(text_col).rlike(r"\S")))
    if chars_col in docs.columns:
        found = found.withColumn(chars_col, F.when(F.col("n_removed") > 0, F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return found.drop("n_lines", "n_removed").withColumnsRenamed({lines: "n_lines", removed: "n_removed"}).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
