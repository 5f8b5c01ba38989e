"""Sharding by jump consistent hashing.

Lamping and Veach's jump hash sends a key to one of ``n`` shards with no table of shards: a
generator seeded with the key proposes ever larger shard numbers, and the last one below ``n`` is
the shard. With one shard more, a key either stays or jumps into the new shard. Everything here is
a DataFrame expression; 64-bit products are formed from limbs, as ANSI arithmetic may not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: the multiplier of the published jump hash.
MULTIPLIER = 2862933555777941757
_LIMBS = [MULTIPLIER >> (16 * i) & 0xFFFF for i in range(4)]
_LOW = 0xFFFFFFFF


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of ``key * MULTIPLIER + 1`` modulo 2**64, no step of which leaves 63 bits."""
    c0, c1, c2, c3 = _LIMBS
    low = lo * c0 + F.shiftleft((lo * c1).bitwiseAND(0xFFFF), 16) + 1
    high = (
        F.shiftright(low, 32)
        + F.shiftright(lo * c1, 16)
        + lo * c2
        + F.shiftleft((lo * c3).bitwiseAND(0xFFFF), 16)
        + hi * c0
        + F.shiftleft((hi * c1).bitwiseAND(0xFFFF), 16)
    )
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def jump_shards(key: Column, n_shards: int) -> Column:
    """Struct of ``shard`` among ``n_shards`` and ``grown_shard`` among one shard more.

    ``key`` is hashed first, so that running numbers spread as well as random ones. A null key is a
    key like any other. Each step of the walk proposes a larger shard, so ``n_shards + 1`` steps
    always suffice; once past the end the state stays as it is.
    """
    hashed = F.xxhash64(key)
    start = F.struct(
        F.shiftrightunsigned(hashed, 32).alias("hi"),
        hashed.bitwiseAND(_LOW).alias("lo"),
        F.lit(0).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("grown"),
        F.lit(0).cast("bigint").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        jump = F.floor((s["next"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1)))
        return F.when(
            s["next"] <= n_shards,
            F.struct(
                hi.alias("hi"),
                lo.alias("lo"),
                F.when(s["next"] < n_shards, s["next"]).otherwise(s["shard"]).alias("shard"),
                s["next"].alias("grown"),
                jump.cast("bigint").alias("next"),
            ),
        ).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(n_shards + 1)),
        start,
        step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown_shard")),
    )


def shard_by_key(
    df: DataFrame, key: str, n_shards: int, payload: list[str], blocks: int = 1024, run: int = 10_000
) -> DataFrame:
    """``key``, ``payload``, ``shard``, ``grown_shard`` and ``slot`` (gapless from 0 in each shard).

    The shard depends on the key and the number of shards alone. Slots come from two levels of
    counting: every shard is cut into ``blocks`` by hash, block sizes are summed (at most
    ``n_shards * blocks`` rows, which is what is broadcast), and rows are numbered inside a block
    only. Equal rows are counted before the shuffle and unfolded after it, in runs of ``run``, so a
    key that holds a third of all rows costs one row per map task.

    Nulls, repeated rows and empty tables are allowed; other columns of ``df`` are ignored, so their
    names can't clash.
    """
    own = list(dict.fromkeys([key, *payload]))
    placed = (
        df.select(*own)
        .withColumn("__to", jump_shards(F.col(key), n_shards))
        .withColumn("__block", F.pmod(F.xxhash64(*own, F.lit(17)), F.lit(blocks)).cast("int"))
        .groupBy("__to", "__block", *own)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    in_shard = W.partitionBy("__shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(F.col("__to.shard").alias("__shard"), "__block")
        .agg(F.sum("__n").alias("__size"))
        .select("__shard", "__block", F.coalesce(F.sum("__size").over(in_shard), F.lit(0)).alias("__offset"))
    )
    in_block = W.partitionBy("__shard", "__block").orderBy(*own).rowsBetween(W.unboundedPreceding, -1)
    numbered = (
        placed.withColumn("__shard", F.col("__to.shard"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(in_block), F.lit(0)))
        .join(F.broadcast(offsets), ["__shard", "__block"])
        .withColumn("__first", F.col("__offset") + F.col("__before"))
    )
    last = F.col("__n") - 1
    return (
        numbered.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor(last / run).cast("bigint"))))
        .withColumn("__at", F.explode(F.sequence(F.col("__run") * run, F.least(last, F.col("__run") * run + run - 1))))
        .select(
            *own,
            F.col("__to.shard").alias("shard"),
            F.col("__to.grown_shard").alias("grown_shard"),
            (F.col("__first") + F.col("__at")).alias("slot"),
        )
    )


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Shards of ``docs`` (doc_id, text) under the law ``key``, with sizes and checksums of texts.

    A null text has 8 bytes and the checksum of no bytes, 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_by_key(rows, "doc_id", n_shards, ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
