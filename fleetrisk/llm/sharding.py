"""Sharding by jump consistent hashing, with built-in column functions only.

The shard of a row follows from its key and the number of shards alone: a generator seeded
by the key draws the next shard count at which the row would move, and the last jump below
the number of shards is the row's shard. With one shard more, a row either stays or goes to
the new shard. No ring table is kept.

The generator is the published one, a 64-bit linear congruential generator. Spark's ``*``
raises on overflow, so a product modulo 2^64 is put together from 32-bit halves.

Defined results. Law ``key``: ``doc_id`` and the number of shards decide, so repeated rows
share a shard and equal texts under different ids need not. A NULL doc_id is key 0. NULL
texts have size 8 and the checksum of no bytes, 0. Rows with equal ids are numbered by size
and checksum; rows equal in all of these are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.numbering import bucket_of, running_sum

SHARDS = 24
ROW_BYTES = 8
#: Constants of the generator (fixed values of the published method).
FACTOR = 2862933555777941757
INCREMENT = 1
#: Jumps tried before the exact tail; a row needs about ln(shards) of them.
JUMPS = 64

_LOW = 0xFFFFFFFF
_FACTOR_HIGH, _FACTOR_LOW = FACTOR >> 32, FACTOR & _LOW


def _half(x: Column, y: int) -> Column:
    """x * y modulo 2^32 for 32-bit values held in longs."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(y)
    high = (F.shiftright(x, 16) * F.lit(y)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_LOW))


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state of the generator, as two 32-bit halves held in longs."""
    p0 = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_FACTOR_LOW) + F.lit(INCREMENT)
    p1 = F.shiftright(low, 16) * F.lit(_FACTOR_LOW)
    total = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(total, 32) + F.shiftright(p1, 16)
    new_high = (carry + _half(low, _FACTOR_HIGH) + _half(high, _FACTOR_LOW)).bitwiseAND(F.lit(_LOW))
    return new_high, total.bitwiseAND(F.lit(_LOW))


def _jump(state: Column, shards: Column) -> Column:
    """One jump, if the last one is still below ``shards``."""
    high, low = _step(state["high"], state["low"])
    # (state >>> 33) + 1 divides 2^31; the division is in doubles, as published.
    reach = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
    moved = F.struct(state["next"].alias("shard"), reach.cast("bigint").alias("next"), high.alias("high"), low.alias("low"))
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key."""
    count = F.lit(shards).cast("bigint")
    start = F.struct(F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"),
                     F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_LOW)).alias("low"))

    def jumps(state: Column, times: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), state, lambda s, _: _jump(s, count))

    state = jumps(start, min(JUMPS, shards))
    if shards > JUMPS:
        # A jump moves by one shard at least, so so many more always end it.
        state = F.transform(F.array(state), lambda s: F.when(s["next"] < count, jumps(s, shards - JUMPS)).otherwise(s))[0]
    return state["shard"].cast("int")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document row: size, checksum, shard, place within the shard, shard among one more."""
    key = F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint")
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"), jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    # Places within a shard: buckets by a hash of the id, rows by id within a bucket.
    each = documents.count() / shards
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.withColumn("bucket", bucket_of(share, F.lit(each)))
    placed = running_sum(rows, "shard", "bucket", ["doc_id", "size", "text_crc32"], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
