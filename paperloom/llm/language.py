"""Language identification by a linear-chain conditional random field over words (operator 6).

Each word of a text gets a language: its features (lexicon membership, affixes, character n-grams) give a score for
each label, learnt transitions tie neighbours, and forward-backward gives each word's probabilities, so passages in
another language keep their own label. A text's language is the one with the largest expected share of its letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import held_out

#: The model is fitted on at most so many rows of each language, those with the smallest hash of their id, ...
SAMPLE = 150
#: ... on fewer of each where there are so many languages that it would be more rows in all, ...
SAMPLE_ROWS = 10_000
#: ... and of these on as many whole texts as have so many bytes in all.
SAMPLE_BYTES = 64_000_000
HASHED, LEXICON, SEGMENT = 1 << 15, 400, 32
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall((text or "").lower())


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _hash(kind: int, *letters: np.ndarray) -> np.ndarray:
    """Below HASHED, for strings of up to four letters given letter by letter, 0 where they end."""
    h = np.full(len(letters[0]), kind, np.uint64) * np.uint64(0x27D4EB2F165667C5)
    for x, f in zip(letters, _FACTORS):
        h += x * f
    h ^= h >> np.uint64(33)
    h *= _FACTORS[3]
    return ((h >> np.uint64(40)) & np.uint64(HASHED - 1)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) for many words at a time, in no order: prefixes and suffixes of one to three letters, n-grams of two and three letters
    of the whole word between ^ and $, each time they occur, short words themselves, and the lexicons that have the word.

    Features are indices, below HASHED for letters and from there for the lexicons.
    """
    n = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    begin = np.cumsum(n + 2) - n - 2
    of = np.repeat(np.arange(len(words)), n + 2)
    left = (begin + n + 2)[of] - np.arange(len(c))
    first = [np.where(n > k, c[np.minimum(begin + 1 + k, len(c) - 1)], np.uint64(0)) for k in range(4)]
    last = [np.where(n > k, c[np.maximum(begin + n - k, 0)], np.uint64(0)) for k in range(3)]
    two, three, short = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3), np.flatnonzero(n <= 4)
    each = np.arange(len(words))
    found = [(of[two], _hash(2, c[two], c[two + 1])), (of[three], _hash(3, c[three], c[three + 1], c[three + 2])), (short, _hash(4, *(x[short] for x in first)))]
    for k in range(1, 4):
        found += [(each, _hash(10 + k, *first[:k])), (each, _hash(20 + k, *last[:k]))]
    known = [(i, HASHED + y) for i, w in enumerate(words) for y in lexicon.get(w, ())]
    found.append(tuple(np.array(known, np.int64).reshape(-1, 2).T))
    return tuple(np.concatenate(x) for x in zip(*found))


def word_features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    return features([word], lexicon)[1].tolist()


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # feature x label
    transitions: np.ndarray  # label x label
    start: np.ndarray
    lexicon: dict[str, list[int]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of each word for each label."""
        word, feature = features(words, self.lexicon)
        return np.stack([np.bincount(word, w[feature], minlength=len(words)) for w in self.weights.T], axis=1).astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Each word's label probabilities, for many sequences at a time.

    ``scores`` holds the words of all sequences one after the other; sequences are taken step by step together, the
    longest first, so those that have ended leave the front rows. With ``pairs`` also the expected transitions, the
    expected first labels and the log-likelihood's normaliser.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    base = np.concatenate(([0], np.cumsum(live)))
    where = np.empty(n, np.int64)  # rows by step
    for t in range(steps):
        where[base[t] : base[t + 1]] = first[: live[t]] + t
    s = scores[where]
    s = s - s.max(axis=1, keepdims=True)
    e = np.exp(s)
    a, move, begin = np.empty_like(e), np.exp(transitions).astype(e.dtype), np.exp(start).astype(e.dtype)
    for t in range(steps):
        x, y = base[t], base[t + 1]
        now = begin * e[x:y] if t == 0 else (a[base[t - 1] : base[t - 1] + live[t]] @ move) * e[x:y]
        a[x:y] = now / now.sum(axis=1, keepdims=True)
    b = np.ones_like(e)
    for t in range(steps - 2, -1, -1):
        x, m = base[t], live[t + 1]
        nxt = base[t + 1]
        now = (b[nxt : nxt + m] * e[nxt : nxt + m]) @ move.T
        b[x : x + m] = now / now.sum(axis=1, keepdims=True)
    p = a * b
    p /= p.sum(axis=1, keepdims=True)
    out = np.empty_like(p)
    out[where] = p
    if not pairs:
        return out
    moved = np.zeros((k, k))
    for t in range(steps - 1):
        m, x, nxt = live[t + 1], base[t], base[t + 1]
        joint = a[x : x + m, :, None] * move[None] * (e[nxt : nxt + m] * b[nxt : nxt + m])[:, None, :]
        moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out, moved, p[: live[0]].sum(axis=0)


def fit(texts: list[str], langs: list[str], rounds: int = 60, rate: float = 0.15, seed: int = 6) -> Model:
    """Maximum likelihood with a small L2 by Adam.

    Every word of a text carries its language; segments of texts in different languages are put end to end as
    code-switched sequences, from which transitions are learnt.
    """
    labels = sorted(set(langs))
    k = len(labels)
    rng = np.random.default_rng(seed)
    counts, segments = [Counter() for _ in labels], []
    for text, lang in zip(texts, langs):
        words, y = words_of(text), labels.index(lang)
        counts[y].update(words)
        segments += [([(w, y) for w in words[at : at + SEGMENT]]) for at in range(0, len(words), SEGMENT)]
    lexicon: dict[str, list[int]] = {}
    for y, c in enumerate(counts):
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 1:
                lexicon.setdefault(w, []).append(y)
    dims = HASHED + k
    model = Model(labels, np.zeros((dims, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    if k < 2:
        return model
    mixed = [segments[i] for i in rng.permutation(len(segments))]
    sequences = [[*mixed[i], *(mixed[i + 1] if i + 1 < len(mixed) else [])] for i in range(0, len(mixed), 2)]
    lengths = np.array([len(s) for s in sequences])
    flat = [x for s in sequences for x in s]
    index: dict[str, int] = {}
    word = np.array([index.setdefault(w, len(index)) for w, _ in flat])
    y = np.array([v for _, v in flat])
    rows, cols = features(list(index), lexicon)
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(index)))
    by_col = np.argsort(cols, kind="stable")
    used, at = np.unique(cols[by_col], return_index=True)
    begins = np.cumsum(lengths) - lengths
    inside = np.ones(len(flat), bool)
    inside[begins] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
    first = np.bincount(y[begins], minlength=k)
    w, tr, st = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    place = np.searchsorted(used, cols)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, tr, st)]
    gold = np.zeros((len(index), k))
    np.add.at(gold, (word, y), 1)
    for r in range(1, rounds + 1):
        emissions = np.add.reduceat(w[place], starts, axis=0)
        p, moved, begun = forward_backward(emissions[word], lengths, tr, st, pairs=True)
        expected = np.stack([np.bincount(word, p[:, c], minlength=len(index)) for c in range(k)], axis=1)
        g = np.add.reduceat((gold - expected)[rows[by_col]], at, axis=0)
        grads = [g / len(flat) - 1e-6 * w, (seen - moved) / len(flat), (first - begun) / len(flat)]
        for x, d, (m, v) in zip((w, tr, st), grads, moments):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model.weights[used] = w
    return Model(labels, model.weights, tr, st, lexicon)


def train(docs: DataFrame, sample: int = SAMPLE, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns every label from at most ``sample`` of its rows, none of them held out.

    Rows are at most ``sample_rows`` in all, but one at least of each label, and their texts have at most
    ``sample_bytes``: from each label in turn the row with the next smallest hash of its id is taken until then.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null").where(~held_out(F.col("id")))
    labels = rows.agg(F.countDistinct("lang")).first()[0]
    if not labels:
        return fit([], [])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.select("id", "lang", turn.alias("turn")).where(F.col("turn") <= max(1, min(sample, sample_rows // labels)))
    chosen = chosen.groupBy("id", "lang").agg(F.min("turn").alias("turn"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen), ["id", "lang"]).where("text is not null")
    # a window over all, but over the sample's rows only
    before = F.sum(F.octet_length("text")).over(Window.orderBy("turn", "lang", "id", "text").rowsBetween(Window.unboundedPreceding, -1))
    got = got.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("turn") == 1) | (F.col("before") < sample_bytes)).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), got["lang"].to_pylist())


class Labeller:
    """Keeps the scores of words that it has met."""

    def __init__(self, model: Model):
        self.model, self.index, self.table = model, {}, np.zeros((0, len(model.labels)), np.float32)

    def scores(self, words: list[list[str]]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.index.clear()
            self.table = self.table[:0]
        if new := list(set().union(*words).difference(self.index)):
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.table = np.concatenate([self.table, *(self.model.emissions(new[at : at + 20_000]) for at in range(0, len(new), 20_000))])
        return self.table[np.fromiter((i for w in words for i in map(self.index.__getitem__, w)), np.int64)]

    def shares(self, words: list[list[str]]) -> np.ndarray:
        """For each text the expected share of its letters in each language."""
        lengths = np.array([len(w) for w in words])
        p = forward_backward(self.scores(words), lengths, self.model.transitions, self.model.start)
        letters = np.fromiter((len(x) for w in words for x in w), np.float32)
        out = np.add.reduceat(p * letters[:, None], np.cumsum(lengths) - lengths, axis=0).astype(float)
        return out / out.sum(axis=1, keepdims=True)

    def words(self, text: str | None) -> list[tuple[str, str, float]]:
        """Each word with its label and probability."""
        if not (words := words_of(text)):
            return []
        p = forward_backward(self.scores([words]), np.array([len(words)]), self.model.transitions, self.model.start)
        return [(w, self.model.labels[int(x.argmax())], float(x.max())) for w, x in zip(words, p)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 400_000) -> DataFrame:
    """doc_id, lang_pred, score and shares (label to share) for every row.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is every text when no label was
    learnt. Ties go to the label first in the alphabet; repeated rows are labelled each; an empty table gives no rows;
    other columns are not looked at. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, labels = Labeller(model), model.labels
        for batch in batches:
            found: list[tuple[str, float, list | None]] = [("und", 0.0, None)] * batch.num_rows
            held, places, total = [], [], 0

            def flush() -> None:
                if not held:
                    return
                for i, share in zip(places, labeller.shares(held) if len(labels) > 1 else np.ones((len(held), 1))):
                    best = int(share.argmax())
                    found[i] = (labels[best], float(min(1.0, share[best])), list(zip(labels, map(float, share))))
                held.clear()
                places.clear()

            for i, text in enumerate(batch.column(1)):
                if labels and (w := words_of(text.as_py())):
                    held.append(w)
                    places.append(i)
                    total += len(w)
                    if total >= words_at_once:
                        flush()
                        total = 0
            flush()
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "shares"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")


def op6(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
