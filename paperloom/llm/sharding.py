"""Sharding by a permutation-filled lookup table (operator 2).

Every shard has its own order of preference over the slots of a table of prime size: an offset and a step, both from
its name. Shards take turns, each claiming its next slot that is still free, until the table is full. A key's hash
modulo the size gives its slot and the slot its shard. Shards differ by at most one slot, and when one comes or goes
nearly all slots stay where they were.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import free_names

SHARDS = tuple(f"shard-{k:04d}" for k in range(64))
#: Prime; at least a hundred times the shards keeps their shares within one per cent.
SLOTS = 65537
#: The table is broadcast; a larger one is refused.
MOST_SLOTS = 4_000_000


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if slots > MOST_SLOTS or slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number("offset:" + s) % slots for s in shards]
    step = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]], free = k, free - 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Hash slot of a key's string form; 60 bits of its MD5. A null key counts as empty."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def shard(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``docs`` with two more columns (replaced if there): the slot of ``key`` and its shard's name.

    One pass without a shuffle, however skewed the keys; rows with equal keys share a shard. A null key is placed like
    an empty string, a key of any length by its hash. An empty table gives an empty one; columns may have any names.
    The table is a broadcast of ``slots`` rows, a bound that doesn't depend on the data.
    """
    table = lookup_table(shards, slots)
    names = F.split(F.lit("\n".join(shards)), "\n")
    spark = docs.sparkSession
    slot, owner, at = free_names([*docs.columns, slot_name, shard_name], 3)
    filled = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")).alias(slot, "k"))
    filled = filled.select(slot, F.get(names, F.col("k")).alias(owner))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (slot_name, shard_name)]
    placed = docs.select(*rest, slot_of(docs[key], slots).alias(at))
    joined = placed.join(F.broadcast(filled), F.col(at) == F.col(slot))
    return joined.select(*rest, F.col(slot).alias(slot_name), F.col(owner).alias(shard_name))


def op2(docs: DataFrame) -> DataFrame:
    return shard(docs.select("doc_id")).select("doc_id", "slot", "shard")


def op2_sql() -> str:
    table = ",".join(map(str, lookup_table()))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS owner),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 4, '0') AS shard FROM d, t"""
