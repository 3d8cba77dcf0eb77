"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free_name, with_result

# Multiplier of the generator of jump consistent hashing, in limbs of 22, 21 and 21 bits.
_MULTIPLIER = 2862933555777941757
_M0, _M1, _M2 = _MULTIPLIER & (1 << 22) - 1, _MULTIPLIER >> 22 & (1 << 21) - 1, _MULTIPLIER >> 43
#: Rows of a shard are numbered in this many chunks, so that no task numbers a whole shard.
CHUNKS = 4096
#: Copies of a row that are numbered by one array.
PIECE = 1 << 16
#: Jumps taken for every key at once; the few keys that need more go on alone.
COMMON_JUMPS = 40


def _jump(state: Column, shards: int) -> Column:
    """One jump. The 64-bit state is three limbs, since bigint products would overflow."""
    k0, k1, k2 = state["k0"], state["k1"], state["k2"]
    c0 = k0 * _M0 + 1
    c1 = F.shiftright(c0, 22) + k0 * _M1 + k1 * _M0
    c2 = F.shiftright(c1, 21) + k0 * _M2 + k1 * (2 * _M1) + k2 * _M0
    n0, n1, n2 = c0.bitwiseAND((1 << 22) - 1), c1.bitwiseAND((1 << 21) - 1), c2.bitwiseAND((1 << 21) - 1)
    high = F.shiftleft(n2, 10) + F.shiftright(n1, 11)
    to = F.floor((state["to"] + 1).cast("double") * (F.lit(2.0**31) / (high + 1).cast("double"))).cast("long")
    live = state["to"] < shards
    new = F.struct(n0.alias("k0"), n1.alias("k1"), n2.alias("k2"), state["to"].alias("at"), to.alias("to"))
    return F.when(live, new).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a 64-bit key: no ring table, and a further shard only takes rows into itself.

    A null key counts as 0. Every row takes COMMON_JUMPS jumps; rows still
    under `shards` then (for a million shards, one key in some millions) go on,
    so the result is exact for any number of shards.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    long = F.coalesce(key.cast("long"), F.lit(0))
    first = F.struct(long.bitwiseAND((1 << 22) - 1).alias("k0"), F.shiftright(long, 22).bitwiseAND((1 << 21) - 1).alias("k1"),
                     F.shiftrightunsigned(long, 43).alias("k2"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    start = F.transform(F.array(first), lambda s: s)[0]
    common = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, COMMON_JUMPS))), start, lambda s, _: _jump(s, shards), lambda s: s)
    if shards <= COMMON_JUMPS:
        return common["at"].cast("int")
    rest = F.aggregate(F.sequence(F.lit(COMMON_JUMPS + 1), F.lit(shards)), common, lambda s, _: _jump(s, shards), lambda s: s["at"])
    return F.when(common["to"] < shards, rest).otherwise(common["at"]).cast("int")


def assign_shards(df: DataFrame, key: str | Column = "doc_id", shards: int = 8) -> DataFrame:
    """Adds `shard` (law `key`): the key and the number of shards decide. No shuffle; all rows stay.

    The key is any integer expression. Equal keys meet in one shard, so equal
    texts under different keys may part. Input columns named `shard` are replaced.
    """
    return with_result(df, "shard", jump_shard(F.col(key) if isinstance(key, str) else key, shards))


def number_slots(df: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """Adds `slot`: rows of each shard numbered from 0 without gaps, the same in every run.

    Equal rows are counted first, so one row repeated without end is one row in
    the shuffle. Distinct rows are dealt to `chunks` parts of a shard by hash; a
    part is numbered by itself and starts where the parts before it end.
    Columns must be groupable (no maps). A null shard is a shard of its own.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == "slot"])
    columns = df.columns
    copies, chunk, before, total, start, of_shard, of_chunk, piece = (free_name(df, f"_{n}") for n in ("copies", "chunk", "before", "sum", "start", "shard_of", "chunk_of", "piece"))
    named = [F.col(f"`{c}`") for c in columns]
    part = F.pmod(F.xxhash64(*named), F.lit(chunks))
    dealt = df.groupBy(*named).agg(F.count(F.lit(1)).alias(copies)).withColumn(chunk, part)
    order = W.partitionBy("shard", chunk).orderBy(*named)
    within = dealt.withColumn(before, F.coalesce(F.sum(copies).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = df.groupBy("shard", part.alias(chunk)).agg(F.count(F.lit(1)).alias(total))  # whole rows need not move for this
    earlier = F.sum(total).over(W.partitionBy("shard").orderBy(chunk).rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(F.col("shard").alias(of_shard), F.col(chunk).alias(of_chunk), F.coalesce(earlier, F.lit(0)).alias(start))
    placed = within.join(starts, F.col("shard").eqNullSafe(F.col(of_shard)) & (F.col(chunk) == F.col(of_chunk)))
    # copies in two steps, so that a row repeated without end needs no array of that length
    first, last = F.col(before) + F.col(start), F.col(before) + F.col(start) + F.col(copies) - 1
    pieces = placed.select(*named, last.alias(total), F.explode(F.sequence(first, last, F.lit(PIECE))).alias(piece))
    return pieces.select(*named, F.explode(F.sequence(F.col(piece), F.least(F.col(piece) + PIECE - 1, F.col(total)))).alias("slot"))
