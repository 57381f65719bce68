"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; there is no ring table.
Going from n to n + 1 shards moves about 1 / (n + 1) of the keys, all of them into the new
shard.  Everything is built-in column arithmetic; the row numbers inside the shards come from
a window over (shard, lane) plus a small table of lane sizes, never from one window per shard.

Defined cases: a null key hashes as 0; a null text has no bytes (size 1, checksum 0); repeated
rows land in the same shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published jump hash.
MULTIPLIER = 2862933555777941757
#: Jumps are about ln(shards) in number; a row that needed more than this would raise.
MAX_JUMPS = 128
#: Slots are numbered in this many lanes per shard.
LANES = 512


def _next_key(key: Column) -> Column:
    """One step of the 64-bit generator.  The key is held as a decimal in [0, 2^64)."""
    product = key.cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    return (product.cast("decimal(38,0)") % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of an integer key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    whole = F.coalesce(key.cast("bigint"), F.lit(0))
    unsigned = F.when(whole < 0, whole.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(whole.cast("decimal(20,0)")).cast("decimal(20,0)")
    start = F.struct(unsigned.alias("key"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(state: Column, _: Column) -> Column:
        key = _next_key(state["key"])
        # the top 31 bits, plus one
        top = F.floor(key.cast("decimal(20,0)") / F.lit(2**33).cast("decimal(10,0)")).cast("bigint") + F.lit(1)
        to = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(float(2**31)) / top.cast("double"))).cast("bigint")
        moved = F.struct(key.alias("key"), state["j"].alias("b"), to.alias("j"))
        return F.when(state["j"] < F.lit(shards), moved).otherwise(state)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS))), start, step)
    shard = last["b"].cast("int")
    return shard if shards <= MAX_JUMPS else F.when(last["j"] >= F.lit(shards), shard).otherwise(F.raise_error(F.lit("jump hash needs more steps")).cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", lanes: int = LANES) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row.

    ``slot`` counts 0, 1, ... without gaps inside a shard; ``grown_shard`` is the shard of the
    row if one more shard is appended."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", jump_hash(F.col(key), shards)).withColumn("grown_shard", jump_hash(F.col(key), shards + 1))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(lanes)).cast("int"))
    # shards x lanes counts: a bounded table
    sizes = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "lane").orderBy(F.col(key), "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within) - F.lit(1))
    return numbered.join(F.broadcast(starts), ["shard", "lane"]).select(
        key, "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("bigint").alias("slot"), "grown_shard"
    )
