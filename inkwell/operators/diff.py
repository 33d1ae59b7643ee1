"""The change between two reports, and which files need counting for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.files import COUNTERS
from inkwell.operators.report import label


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths to count: all but those on both sides with equal content ids; an unknown id is never equal to anything."""
    b = before.select("path", F.col("content_id").alias("b_id"))
    a = after.select("path", F.col("content_id").alias("a_id"))
    return b.join(a, "path", "full_outer").where(~F.coalesce(F.col("b_id") == F.col("a_id"), F.lit(False))).select("path")


def content_id(content: Column) -> Column:
    """The object id that git gives a file, so that directories can be compared with revisions by it."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.lit(b"\0"), data))


def _signed(before: DataFrame, after: DataFrame) -> DataFrame:
    minus = before.withColumns({c: -F.col(c) for c in COUNTERS}).withColumn("files", F.lit(-1).cast("long"))
    return after.withColumn("files", F.lit(1).cast("long")).unionByName(minus)


def _any_changed(columns) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c) != 0 for c in columns))


def diff_by(before: DataFrame, after: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """After less before by any expression; keys without change are dropped. A union and one aggregation, no join."""
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTERS]
    return _signed(before, after).groupBy(key.alias(name)).agg(*sums).where(_any_changed(COUNTERS))


def diff_rows(before: DataFrame, after: DataFrame, dimension: str = "language", depth: int = 1, families: bool = True) -> DataFrame:
    """(family, label, files, counters) of net change; rows stay where the number of files or any counter changed."""
    family = F.col("family") if families and dimension == "language" else F.lit(None).cast("string")
    sums = [F.sum(c).cast("long").alias(c) for c in ("files", *COUNTERS)]
    grouped = _signed(before, after).groupBy(family.alias("family"), label(dimension, depth).alias("label")).agg(*sums)
    return grouped.where(_any_changed(("files", *COUNTERS)))
