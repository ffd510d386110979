"""Sharding by jump consistent hashing (Lamping & Veach 2014), in column expressions.

``jump_hash`` needs no ring table: the key seeds a linear congruential
generator, and the generator decides at which shard counts the key would have
jumped to the newest shard.  Going from n to n + 1 shards therefore moves
1/(n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published generator.
MULTIPLIER = "2862933555777941757"
MODULUS = "18446744073709551616"
_STATE = "struct<k: decimal(20,0), b: bigint, j: bigint>"
#: Jumps taken in the first loop; ln(n) are expected.  A key that needs more goes on in a second loop.
FIRST_JUMPS = 64


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard (int, 0 to n_shards - 1) of an integer key; a null key counts as 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    n = F.lit(n_shards).cast("bigint")
    modulus = F.lit(MODULUS).cast("decimal(20,0)")
    seed = F.pmod(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")).cast("decimal(20,0)"), modulus)

    def jump(state: Column, _: Column) -> Column:
        k = ((state["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % modulus).cast("decimal(20,0)")
        high = F.floor(k.cast("decimal(31,11)") / F.lit(8589934592).cast("decimal(10,0)")).cast("double")
        j = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (high + F.lit(1.0)))).cast("bigint")
        moved = F.struct(k.alias("k"), state["j"].alias("b"), j.alias("j")).cast(_STATE)
        return F.when(state["j"] < n, moved).otherwise(state)

    start = F.struct(seed.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j")).cast(_STATE)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(n_shards, FIRST_JUMPS))), start, jump)
    if n_shards > FIRST_JUMPS:
        state = F.aggregate(F.array(F.lit(0)), state, lambda s, _: F.when(s["j"] < n, F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), s, jump)).otherwise(s))
    return state["b"].cast("int")


def shard_sizes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes plus 8) and text_crc32 of every row; a null text has no bytes."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), (F.length(body) + F.lit(8)).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))


def shard_slots(rows: DataFrame, shard: str, *, buckets: int = 256) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard, ordered by bucket and row.

    A shard can hold any number of rows, so no task numbers a whole shard:
    rows are first reduced to distinct rows with a count (a repeated row gives
    interchangeable slots), then numbered within (shard, bucket), and a prefix
    sum over the shards * buckets counts moves each bucket to its place.
    """
    columns = rows.columns
    distinct = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    group = [shard, "__bucket"]
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = distinct.groupBy(*group).agg(F.sum("__n").alias("__rows")).select(*group, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group).orderBy(*[c for c in columns if c != shard]).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(starts, group)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("__copy")
    return placed.select(*columns, "__start", "__before", copies).select(*columns, (F.col("__start") + F.col("__before") + F.col("__copy")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard under n_shards and under one more.

    Returns doc_id, size, text_crc32, law (``key``), shard, slot, grown_shard.
    The key and the shard count alone decide, so equal keys share a shard and
    a null key goes where key 0 goes.  An empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    sized = shard_sizes(docs, key=key, text=text)
    placed = sized.withColumn("shard", jump_hash(F.col("doc_id"), n_shards)).withColumn("grown_shard", jump_hash(F.col("doc_id"), n_shards + 1))
    return shard_slots(placed, "shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
