"""Placement by a permutation-filled lookup table of prime size, in DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 4093  # a prime: every step between 1 and 4092 visits every slot
SHARDS = tuple(f"shard-{k:02d}" for k in range(32))


def _number(text: str, first: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[first : first + 8], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot.

    A shard prefers slots in the order offset, offset + step, offset + 2 step ... modulo the size,
    both numbers taken from its name.  Shards claim in turn the best slot that is still free.  The
    table's size is a parameter and has nothing to do with the data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    at = [_number(s, 0) % slots for s in shards]
    step = [_number(s, 8) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return owner


def lookup(spark: SparkSession, slots: int = SLOTS, **shards: Sequence[str]) -> DataFrame:
    """slot and one column per named list of shards: ``slots`` rows, made from string literals."""
    indices = [F.split(F.lit(",".join(map(str, fill(names, slots)))), ",").alias(c) for c, names in shards.items()]
    rows = spark.range(1).select(F.posexplode(F.arrays_zip(*indices)).alias("slot", "index"))
    owner = {c: F.array(*map(F.lit, names))[F.col(f"index.{c}").cast("int")] for c, names in shards.items()}
    return rows.select("slot", *[e.alias(c) for c, e in owner.items()])


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 32 bits of the MD5 of its text; a null key counts as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, more: str = "shard-new") -> DataFrame:
    """key, slot, shard, and grown_shard: where the row goes once the shard ``more`` joins.

    One row per input row, also for repeated and null keys; equal keys go to one shard.  Both
    tables have ``slots`` rows, so broadcasting them is bounded, and rows are never shuffled: a
    hot key costs nothing here.
    """
    tables = lookup(docs.sparkSession, slots, shard=shards, grown_shard=[*shards, more])
    return docs.select(F.col(key).alias(key), slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(tables), "slot").select(
        key, "slot", "shard", "grown_shard"
    )
