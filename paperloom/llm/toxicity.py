"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 9).

Features of a text are the set of its words, pairs of neighbours and pairs with one word between, as 32-bit hashes.
Learning is online: each coordinate has its own rate, and L1 leaves most weights at zero. What is left, some thousand
hashes and weights, goes to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperloom.llm.bytewords import Texts, texts_of
from paperloom.llm.common import free_names, give_back, held_out, release_caches

#: The model is fitted on at most so many labelled rows, those with the smallest hash of their id, ...
SAMPLE = 10_000
#: ... and of these on as many whole texts as have so many bytes in all.
SAMPLE_BYTES = 128_000_000
THRESHOLD = 0.3
#: Features met in fewer rows of the sample are not learnt.
LEAST_ROWS = 3
#: White space, controls and ASCII punctuation part words.
APART = np.zeros(256, bool)
APART[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def features(texts: Texts) -> np.ndarray:
    """Words, pairs and skip pairs of each text, A-Z lower-cased: the text's number and the feature's 32-bit hash in one integer, ascending, each once."""
    s, _, h = texts.words(APART)
    of = texts.text_of(s)
    h = (h >> np.uint64(32)).astype(np.uint32)
    pair = h[:-1] * np.uint32(0x9E3779B1) + (h[1:] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    skip = h[:-2] * np.uint32(0x27D4EB2F) + (h[2:] ^ np.uint32(0x165667B1)) * np.uint32(0x9E3779B1)
    one, two = of[1:] == of[:-1], of[2:] == of[:-2]
    both = lambda d, f: (d.astype(np.uint64) << np.uint64(32)) | f
    return np.concatenate([both(of, h), both(of[:-1][one], pair[one]), both(of[:-2][two], skip[two])])


def _once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # ascending uint32
    weights: np.ndarray
    bias: float

    def screen(self) -> np.ndarray:
        """For the top 22 bits of a hash, whether any weight has them."""
        out = np.zeros(1 << 22, bool)
        out[self.hashes >> np.uint32(10)] = True
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability for each text of a string column."""
        total = np.full(len(column), self.bias)
        screen = self.screen()
        for rows, texts in texts_of(column) if len(self.hashes) else ():
            x = features(texts)
            x = _once(x[screen[(x & np.uint64(2**32 - 1)) >> np.uint64(10)]])
            f = (x & np.uint64(2**32 - 1)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.hashes, f), len(self.hashes) - 1)
            hit = self.hashes[at] == f
            total[rows] += np.bincount((x[hit] >> np.uint64(32)).astype(np.int64), self.weights[at[hit]], minlength=rows.stop - rows.start)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _learnable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The features met in LEAST_ROWS texts or more, and for each text which of them it has.

    A first pass counts by the top 24 bits in a table of fixed size, so that most rare features are never held.
    """
    count = np.zeros(1 << 24, np.uint16 if len(column) < 65_536 else np.uint32)
    for _, texts in texts_of(column):
        np.add.at(count, (_once(features(texts)) & np.uint64(2**32 - 1)) >> np.uint64(8), 1)
    kept = []  # for each go its first text, how many features its texts have, and these
    for rows, texts in texts_of(column):
        x = _once(features(texts))
        x = x[count[(x & np.uint64(2**32 - 1)) >> np.uint64(8)] >= LEAST_ROWS]
        kept.append((rows.start, np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=rows.stop - rows.start), (x & np.uint64(2**32 - 1)).astype(np.uint32)))
    del count
    vocabulary = np.concatenate([np.zeros(0, np.uint32), *(f for _, _, f in kept)])
    vocabulary.sort()
    # equal ones lie side by side: one that is the same LEAST_ROWS - 1 further on, and not the same as the one before
    often = vocabulary[: max(0, len(vocabulary) - LEAST_ROWS + 1)] == vocabulary[LEAST_ROWS - 1 :]
    often[1:] &= vocabulary[1 : len(often)] != vocabulary[: max(0, len(often) - 1)]
    vocabulary = vocabulary[: len(often)][often]
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(column)
    while kept and len(vocabulary):
        start, sizes, f = kept.pop()
        at = np.minimum(np.searchsorted(vocabulary, f), len(vocabulary) - 1).astype(np.int32)
        hit = vocabulary[at] == f
        ends = np.append(0, np.cumsum(hit))[np.cumsum(sizes)]
        for r, part in enumerate(np.split(at[hit], ends[:-1]), start):
            found[r] = part
    return vocabulary, found


def fit(texts: list[str | None] | pa.Array, labels: list[int], alpha: float = 5.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01, epochs: int = 4, seed: int = 7) -> Model:
    """Per-coordinate FTRL-proximal; the bias isn't penalised. Features met in fewer than LEAST_ROWS of the texts are not learnt. Without both labels the score is the share of label 1 for every text."""
    y = np.array(labels, float)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    vocabulary, rows = _learnable(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    n = len(vocabulary)
    z, g2 = np.zeros(n), np.zeros(n)
    bias, bias_g2 = float(np.log(share / (1 - share))), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            zi, gi = z[i], g2[i]
            root = np.sqrt(gi)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -40, 40))) - y[k]
            z[i] = zi + g - (np.sqrt(gi + g * g) - root) / alpha * w
            g2[i] = gi + g * g
            bias_g2 += g * g
            bias -= 0.1 / (1 + np.sqrt(bias_g2)) * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(g2)) / alpha + l2))
    return Model(vocabulary[w != 0], w[w != 0], bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from ``labels`` outside the held-out quarter, with null ids and labels left out: at most ``sample`` rows, by the hash of their id, and of these the first whose texts have ``sample_bytes`` in all.

    Of rows that repeat an id the largest text and label count.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null").where(~held_out(F.col("_id")))
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(chosen), "_id")
    # a window over all, but over ``sample`` rows at most
    so_far = F.sum(F.coalesce(F.octet_length("_t"), F.lit(0))).over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.groupBy("_id").agg(F.max("_t").alias("_t"), F.max("_y").alias("_y")).withColumn("_n", so_far).where(F.col("_n") <= sample_bytes).drop("_n").toArrow()
    got = got.sort_by("_id")
    texts, y = pa.concat_arrays([pa.array([], pa.large_string()), *(c.cast(pa.large_string()) for c in got["_t"].chunks)]), got["_y"].to_pylist()
    del got
    model = fit(texts, y)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's probability in a column ``name`` (replaced if there); one pass, no shuffle.

    Null and empty texts have no features and get the score of the bias; texts of any length are read whole; equal texts
    get equal scores, repeated rows one each; an empty table gives an empty one; every other column, whatever its name,
    is passed through.
    """
    rest = [c for c in docs.columns if c != name]
    # columns go through Python by number, as names with dots can't
    numbers = [f"c{k}" for k in range(len(rest))]
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rest, numbers)], F.col(text_col).cast("string").alias("text"))
    out = StructType([*[source.schema[k] for k in numbers], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], pa.array(model.scores(batch.column(len(rest))))], names=[*numbers, "score"])

    return source.mapInArrow(run, out).toDF(*rest, name)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns unchanged, whatever their names.

    Each row is judged by its whole text alone: null and empty texts by the bias, rows that repeat an id or a text each.
    An empty table gives an empty one.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    name = free_names(docs.columns, 1)[0]
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
