"""Shards by rendezvous hashing: every record key scores each shard, and the highest score wins.

A shard's score is ``-weight / ln(u)`` with ``u`` drawn from the MD5 digest of key and shard number, so a shard gets rows in
proportion to its weight, and adding a shard moves only the rows that it wins. Nothing is shuffled to assign shards. Slots number
a shard's rows without gaps: rows are ranked inside blocks of a shard, hashed by key and checksum, and a block's offset is the sum of
the counts of the shard's blocks before it. The number of blocks follows the number of rows, so a shard of any size is ranked by many
tasks, and so are the rows of one key as long as their texts differ.

Defined results: a null text has 0 bytes and the checksum 0, and a very long one is measured as a whole; a null key is hashed as the
word ``null``; repeated rows go to one shard and get different slots; rows of a key are ranked by size, then checksum, and of full ties
either may come first; an empty table gives an empty result; further columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a block of a shard holds, and the most blocks that a shard is cut into: offsets are at most a row for each.
BLOCK_ROWS, MOST_BLOCKS = 1 << 16, 1 << 14
#: Two to the power of 52: thirteen hexadecimal digits of a digest.
SPAN = float(1 << 52)


def _unit(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(-float(weight)) / F.ln((_unit(key, F.lit(shard)) + F.lit(0.5)) / F.lit(SPAN))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score; of equal scores the lowest number. The array has one entry per shard, a fixed parameter."""
    scored = [F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("no")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scored))["no"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard); a shard is ranked in blocks of about ``block_rows`` rows.

    Offsets are one row per shard and block, at most ``len(weights) * MOST_BLOCKS`` rows, and so are broadcast.
    """
    at = F.col(f"`{key}`")
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    # a count that Parquet answers from its footers
    blocks = min(MOST_BLOCKS, max(1, -(-docs.count() // (len(weights) * block_rows))))
    block = F.pmod(_unit(at, F.lit("block"), crc), F.lit(blocks)).cast("int")
    placed = docs.select(
        at.alias("key"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        crc.alias("text_crc32"),
        winner(at, weights).alias("shard"),
        (winner(at, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        block.alias("block"),
    )
    counts = docs.select(winner(at, weights).alias("shard"), block.alias("block")).groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("block").alias("o_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "block").orderBy("key", "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(offsets), (F.col("shard") == F.col("o_shard")) & (F.col("block") == F.col("o_block")))
    return joined.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
