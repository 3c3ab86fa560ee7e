"""Benchmark decontamination by SimHash item-sized windows and exact weighted-shingle similarity (operator 1), in DataFrame functions only.

A window is as long as the benchmark item it may hold and lies where at least one shingle of such an item lines up with
the document. Windows and items have a 64-bit SimHash over their shingles, each weighed alike in both. Two ways name the
items that a window is verified against:

- blocks of the fingerprints: of BLOCKS blocks at least one is equal where fingerprints differ in fewer bits, so every
  pair within that radius is found;
- fingerprints of pairs near the threshold lie some 13 bits apart, and blocks for so many bits would be too narrow to
  tell anything. So of each item also the rarest shingles, together so heavy that a window without any of them can't be
  similar enough, name the item for the windows that hold one of them. Shingles that many items share, as of a template,
  thus name an item only where its own ones weigh too little.

Each named pair is verified by exact weighted similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import free_names, id_back, id_key, text_key, written

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 16 bits; pairs of fingerprints that differ in fewer bits share one.
BLOCKS = 4
#: The items' shingles are broadcast up to so many rows (some 60 bytes each) and joined with a shuffle beyond.
MOST_BROADCAST = 500_000
#: Texts are cut in so many words, and as many more as the longest item has, where windows are taken from them.
PART = 4096


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def shingles_of(hashes: Column, n: int = SHINGLE) -> Column:
    """A 64-bit hash for each run of ``n`` word hashes."""
    at = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))


def simhash(weighed: Column) -> Column:
    """SimHash of an array of structs (h, n, w), in BLOCKS blocks: a bit is set where the shingles that have it weigh more than half."""

    def weight(bit: int | None) -> Column:
        has = lambda x: F.lit(True) if bit is None else F.shiftright(x["h"], bit).bitwiseAND(F.lit(1)) != 0
        return F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + F.when(has(x), x["n"] * x["w"]).otherwise(0.0))

    total, width = weight(None), 64 // BLOCKS
    bits = [F.when(weight(b) * 2 > total, F.lit(1 << b % width)).otherwise(0) for b in range(64)]
    return F.array(*[sum(bits[k + 1 : k + width], bits[k]) for k in range(0, 64, width)])


def leaking_windows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, similarity: float) -> DataFrame:
    """(id, h, item_id, start, length, similarity) of the windows that are similar to an item; id and h as ``id_key`` and ``text_key`` give them."""
    items = benchmark.select(id_key(item_col).alias("item_id"), word_hashes(F.col(item_text_col).cast("string")).alias("wh")).where(F.size("wh") >= SHINGLE).distinct()
    items = written(items, "words").select(F.xxhash64("item_id", "wh").alias("item"), "item_id", F.size("wh").alias("length"), shingles_of(F.col("wh")).alias("hs"))
    lined = written(items.select("item", "item_id", "length", F.posexplode("hs").alias("q", "s")), "items")
    share = lined.groupBy("s").agg((F.lit(1.0) / F.countDistinct("item")).alias("w"))
    own = lined.groupBy("item", "item_id", "length", "s").agg(F.count("*").alias("n")).join(share, "s")
    known = own.groupBy("item", "item_id", "length").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("h"), "n", "w"))).alias("own"), F.sum(F.col("n") * F.col("w")).alias("total"))
    known = written(known.withColumn("print", simhash(F.col("own"))), "known")
    # rarest first; a shingle names its item as long as those from it on weigh enough for a match
    before = F.coalesce(F.sum(F.col("x.n") * F.col("x.w")).over(Window.partitionBy("item").orderBy(F.desc("x.w"), "x.h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    naming = known.select("item", "length", "total", F.explode("own").alias("x")).select("item", "length", F.col("x.h").alias("s"), "total", before.alias("before"))
    naming = naming.where(F.col("total") - F.col("before") >= (similarity - 1e-6) * F.col("total")).select("s", "length", "item")

    anchors = lined.select("s", "length", "q").distinct()
    if anchors.count() <= MOST_BROADCAST:
        anchors, naming, share = F.broadcast(anchors), F.broadcast(naming), F.broadcast(share)
    longest = known.agg(F.max("length")).first()[0] or 0
    text = F.col(text_col).cast("string")
    source = docs.select(id_key(id_col).alias("id"), text_key(text).alias("h"), text.alias("text")).where("text is not null")
    # hashes are columns before their shingles are taken, as a lambda's body is evaluated for each element; and outer
    # explosions, as for others a filter on the array's size is put below that makes them part of it again
    shingled = source.select("id", "h", word_hashes(F.col("text")).alias("wh")).select("id", "h", shingles_of(F.col("wh")).alias("hs"))
    hits = shingled.select("id", "h", F.posexplode_outer("hs").alias("p", "s")).join(anchors, "s").select("id", "h", F.greatest(F.lit(0), F.col("p") - F.col("q")).alias("start"), "length")
    # the few texts with a hit are read again, each once; a part of its words goes with the windows that begin in it
    parts = hits.distinct().groupBy("id", "h", F.floor(F.col("start") / PART).cast("int").alias("part")).agg(F.collect_list(F.struct("start", "length")).alias("at"))
    hit = written(parts.groupBy("id", "h").agg(F.collect_list(F.struct("part", "at")).alias("parts")), "hits")
    held = source.join(F.broadcast(hit) if hit.count() <= MOST_BROADCAST // 10 else hit, ["id", "h"]).dropDuplicates(["id", "h"])
    held = held.select("id", "h", "parts", word_hashes(F.col("text")).alias("wh"))
    cut = held.select("id", "h", F.explode_outer(F.transform("parts", lambda x: F.struct(x["part"].alias("part"), x["at"].alias("at"), F.slice("wh", x["part"] * PART + 1, PART + longest).alias("words")))).alias("c"))
    window = F.transform("c.at", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), F.slice("c.words", x["start"] - F.col("c.part") * PART + 1, x["length"]).alias("words")))
    each = cut.select("id", "h", F.explode_outer(window).alias("x")).select("id", "h", "x.start", "x.length", "x.words")
    windows = written(each.select("id", "h", "start", "length", shingles_of(F.col("words")).alias("hs")), "windows")

    key = ["id", "h", "start", "length"]
    counted = windows.select(*key, F.explode("hs").alias("s")).groupBy(*key, "s").agg(F.count("*").alias("n"))
    # a shingle of no item weighs like one of a single item
    weighed = written(counted.join(share, "s", "left").select(*key, "s", "n", F.coalesce("w", F.lit(1.0)).alias("w")), "weighed")
    content = weighed.groupBy(*key).agg(F.collect_list(F.struct(F.col("s").alias("h"), "n", "w")).alias("own"))
    content = written(content.select(*key, F.map_from_entries(F.transform("own", lambda x: F.struct(x["h"].alias("key"), x["n"].alias("value")))).alias("has"), simhash(F.col("own")).alias("print")), "content")
    by_shingle = weighed.join(naming, ["s", "length"]).select(*key, "item")
    blocks = known.select("item", "length", F.posexplode("print").alias("block", "bits"))
    by_print = content.select(*key, F.posexplode("print").alias("block", "bits")).join(blocks, ["length", "block", "bits"]).select(*key, "item")
    named = by_shingle.union(by_print).distinct()

    both = F.map_zip_with("wanted", "has", lambda k, a, b: F.when(a.isNotNull() & b.isNotNull(), a["w"] * F.least(a["n"], b)).otherwise(0.0))
    found = F.aggregate(F.map_values(both), F.lit(0.0), lambda acc, x: acc + x)
    wanted = known.select("item", "item_id", "total", F.map_from_entries(F.transform("own", lambda x: F.struct(x["h"].alias("key"), F.struct(x["n"].alias("n"), x["w"].alias("w")).alias("value")))).alias("wanted"))
    pairs = named.join(content, key).join(wanted, "item").select("id", "h", "item_id", "start", "length", (found / F.col("total")).alias("similarity"))
    return pairs.where(F.col("similarity") >= similarity - 1e-9)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item it holds: doc_id, item_id, start_word, n_words, similarity.

    Similarity is the weighted share of the item's shingles of five words (each weighs its count over the number of
    items that have it) that the best item-sized window has too; pairs of 0.8 or more are returned. Case, punctuation
    and white space don't count. Null and empty texts hold nothing; texts may be of any length, and the time taken is
    in proportion to it; items under five words are too short to be evidence and match nothing; of equal windows the
    first is named; rows that repeat an id are searched each and reported as one; null ids stay null, in both tables;
    either table may be empty; other columns are not looked at.
    """
    found = leaking_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "length")).alias("m"))
    return best.select(id_back("id").alias("doc_id"), id_back("item_id").alias("item_id"), (-F.col("m").getField("col2")).alias("start_word"), F.col("m.length").alias("n_words"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text holds an item, as ``leaks`` finds them; columns unchanged, whatever their names.

    Clean rows are untouched, also those that share an id, or a null one, with a row that goes; rows equal in id and
    text go together.
    """
    id_, h = free_names(docs.columns, 2)
    found = leaking_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity)
    held = written(found.select(F.col("id").alias(id_), F.col("h").alias(h)).distinct(), "leaks")
    rows = docs.withColumns({id_: id_key(id_col), h: text_key(F.col(text_col).cast("string"))})
    return rows.join(held, [id_, h], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
