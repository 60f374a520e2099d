"""Sharding by jump consistent hashing.

A key walks a pseudo-random sequence of ever larger shard numbers and stays at
the last one below the shard count, so no ring table is kept and a shard that
is appended takes rows only into itself. The sequence is the published 64-bit
linear congruential generator. It is written with 32-bit halves since a
64-bit product overflows in ANSI mode.

Edge cases: a null key counts as -1; a null text is empty (size 16, crc 0);
repeated rows share a shard and get successive slots; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.ranking import gapless_rank
from tallymill.session import materialize

# The multiplier of the published generator, by halves and quarters.
_MH, _ML1, _ML0 = 0x27BB2EE6, 0x87B0, 0xB0FD
_LOW = (1 << 32) - 1
_FIRST_STEPS = 64


def _step(s: Column, top: int, below: int) -> Column:
    """One jump of the state (hi, lo, b, j, kept); as it is once j has reached ``top``."""
    t, u = s.lo * F.lit(_ML0), s.lo * F.lit(_ML1)
    low = t.bitwiseAND(_LOW) + F.shiftleft(u.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(t, 32) + F.shiftright(u, 16)
    cross = (s.hi * F.lit(_ML0)).bitwiseAND(_LOW) + F.shiftleft((s.hi * F.lit(_ML1)).bitwiseAND(0xFFFF), 16)
    high = (carry + (s.lo * F.lit(_MH)).bitwiseAND(_LOW) + cross).bitwiseAND(_LOW)
    draw = (F.shiftright(high, 1) + F.lit(1)).cast("double")
    # the sequence is the same for every shard count: the last stop below each count is that count's shard
    moved = F.struct(
        high.alias("hi"),
        low.bitwiseAND(_LOW).alias("lo"),
        s.j.alias("b"),
        F.floor((s.j + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long").alias("j"),
        F.when(s.j < below, s.j).otherwise(s.kept).alias("kept"),
    )
    return F.when(s.j < top, moved).otherwise(s)


def jump_shards(key: Column, shards: int) -> Column:
    """A struct of the shard among ``shards`` (kept) and among one more (b)."""
    key = F.coalesce(key.cast("long"), F.lit(-1))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"), zero.alias("b"), zero.alias("j"), zero.alias("kept")
    )
    step = lambda s, _: _step(s, shards + 1, shards)
    some = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards + 1, _FIRST_STEPS))), start, step)
    if shards + 1 > _FIRST_STEPS:  # few keys need as many jumps as there are shards
        rest = F.sequence(F.lit(1), F.lit(shards + 1))
        some = F.when(some.j > shards, some).otherwise(F.aggregate(rest, some, step))
    return some


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The one law that holds is ``key``. Slots count from 0 in each shard by
    (key, size, crc), without gaps.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    rows = rows.withColumn("__jump", jump_shards(F.col("doc_id"), shards))
    rows = materialize(
        rows.select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("__jump.kept").cast("int").alias("shard"),
            F.col("__jump.b").cast("int").alias("grown_shard"),
        ),
        "sharded",
    )
    ranked = gapless_rank(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
