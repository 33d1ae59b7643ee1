"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks: eight 32-bit words, one bit set in each per listed URL (the split-block layout). It is built by a
distributed ``bit_or`` and has a block for every ``PER_BLOCK`` listed URLs, which are counted first, so its bytes are known: up to
``MAX_BROADCAST_BYTES`` it is broadcast, beyond that rows are joined to it by block number. URLs that pass may be listed; an exact
hash join with the list removes the false positives.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is never listed; a URL is read as a
whole however long it is; repeated rows each get a verdict; of rules that fit with equal lengths the last by text, then verdict, holds; an
empty list or table gives what it should, allowances or no rows; further input columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.store import cut

MAX_BROADCAST_BYTES = 64 << 20
#: Listed URLs to a block of 256 bits: about one in a hundred others passes.
PER_BLOCK = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd multipliers, one for each word of a block, as the public Parquet format fixes them.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a trailing slash, and the query without tracking fields; scheme and fragment go."""
    host = F.regexp_replace(host_of(url), r"\A(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"\A(?:utm_[a-z]+|ref)="))
    kept = F.array_join(F.sort_array(kept), "&")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of its length, text and verdict. ``rules`` is a short literal list: (verdict, host, path)."""
    fitting = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fitting).cast("array<struct<n:int,rule:string,verdict:string>>"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    low = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    # the five top bits of a 32-bit product; the masks keep the product within a long
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned((low.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(s & 0x7FFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in SALTS]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the ``url`` column of ``listed``; only blocks with a bit set have a row."""
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))]
    return listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(*words)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], blocks: int | None = None, page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``listed`` has canonical URLs in the column ``url``."""
    # the list is made once; its count, the filter and the exact join read it
    listed = cut(listed.where((F.col("url") != "") & F.col("url").isNotNull()).select("url").distinct(), "urls-listed")
    blocks = blocks or max(1, -(-listed.count() // PER_BLOCK))
    read = pages.select(F.col(f"`{page_id}`").alias("page"), F.col("url").alias("raw"))
    read = read.select("page", host_of(F.col("raw")).alias("host"), path_of(F.col("raw")).alias("path"), canonical(F.col("raw")).alias("key"))
    read = read.withColumns({"block": _block(F.col("key"), blocks), "fit": rule_of(F.col("host"), F.col("path"), rules)})
    table = bloom(listed, blocks).withColumnRenamed("block", "b_block")
    if blocks * 36 <= MAX_BROADCAST_BYTES:
        table = F.broadcast(table)
    passed = F.col("b_block").isNotNull() & (F.col("key") != "")
    for i, bit in enumerate(_bits(F.col("key"))):
        passed = passed & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probed = read.join(table, F.col("block") == F.col("b_block"), "left").select("page", "host", "path", "key", "fit", F.coalesce(passed, F.lit(False)).alias("maybe"))
    # only possible hits carry a join key; the rest have null and are not dealt to one task
    probe = F.when(F.col("maybe"), F.col("key"))
    exact = listed.select(F.col("url").alias("hit"))
    found = probed.withColumn("probe", probe)
    hits = found.where("maybe").join(exact, F.col("probe") == F.col("hit"), "left")
    misses = found.where("not maybe").withColumn("hit", F.lit(None).cast("string"))
    verdict = F.coalesce(F.col("fit")["verdict"], F.when(F.col("hit").isNotNull(), "block").otherwise("allow"))
    return hits.unionByName(misses).select(F.col("page").alias(page_id), "host", "path", F.col("fit")["rule"].alias("rule"), verdict.alias("verdict"))
