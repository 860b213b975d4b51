"""Shard placement by a permutation-filled lookup table, in DataFrame functions only.

Every shard has a preference order over the slots of a prime-sized table (an offset and a
skip from its name's digest); shards take turns claiming their next free slot. A key's
digest picks a slot, the slot names the shard: constant time, even shares, and few moves
when a shard is added or lost.

Scale: the table's size is a parameter, not the data's, so it is broadcast; placement is a
map without a shuffle, and files are written from where rows are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 65_537


def slot_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if slots < max(2, len(names)) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is not less than the number of shards")
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct, and at least one")
    digests = [hashlib.sha256(name.encode()).digest() for name in names]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    table = [-1] * slots
    free = slots
    while free:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its md5, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard_id) rows of the lookup table, as a JVM-side relation."""
    listed = F.split(F.lit(",".join(map(str, slot_table(names, slots)))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard_id")
    )


def place(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard_id`` added (columns of these names are replaced).

    A null key is placed as an empty one; equal keys go to the same shard; an empty table
    gives no rows."""
    spark = docs.sparkSession
    own = docs.drop("slot", "shard_id")
    found = own.withColumn("slot", slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), slots))
    table = F.broadcast(table_frame(spark, names or shard_names(), slots))
    return found.join(table, "slot").select(*[found[c] for c in own.columns], found["slot"], table["shard_id"])


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None) -> None:
    """Write one folder a shard; each task appends its own files, so no shard's rows are
    gathered in one task."""
    place(docs, key, names).drop("slot").write.partitionBy("shard_id").parquet(path)


def oracle(n: int = SHARDS, slots: int = SLOTS) -> str:
    listed = ",".join(map(str, slot_table(shard_names(n), slots)))
    return f"""
with p as (select doc_id, (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {slots})::int slot
           from documents),
t as (select string_split('{listed}', ',') s)
select doc_id, slot, cast(s[slot + 1] as int) shard_id from p, t"""
