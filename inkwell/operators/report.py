"""Grouping, totals, ordering and roll-ups of file reports; every sum is a partial and a final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.paths import directory, language_label
from inkwell.operators.files import COUNTERS

DIMENSIONS = ("language", "family", "extension", "file", "directory")
SORTS = ("code", "comments", "blanks", "test", "lines", "name")
TOTAL = "TOTAL"


def lines() -> Column:
    return sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))


def is_empty() -> Column:
    """Whether all six counters are 0."""
    out = F.col(COUNTERS[0]) == 0
    for c in COUNTERS[1:]:
        out = out & (F.col(c) == 0)
    return out


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS]


def label(dimension: str, depth: int = 1) -> Column:
    """The label that a file contributes to along a dimension."""
    kinds = {"language": language_label(F.col("language")), "family": F.col("family"), "extension": F.col("extension"), "file": F.col("path"), "directory": directory(F.col("path"), depth)}
    if dimension not in kinds:
        raise ValueError(f"unknown dimension {dimension!r}; one of {', '.join(DIMENSIONS)}")
    return kinds[dimension]


def totals(report: DataFrame) -> DataFrame:
    """One row; zeros for an empty report."""
    return report.agg(*_sums())


def group_by(report: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Counters by any expression."""
    return report.groupBy(key.alias(name)).agg(*_sums())


def by_language(report: DataFrame) -> DataFrame:
    return group_by(report, label("language"), "language")


def by_family(report: DataFrame) -> DataFrame:
    return group_by(report, label("family"), "family")


def by_extension(report: DataFrame) -> DataFrame:
    return group_by(report, label("extension"), "extension")


def by_path(report: DataFrame) -> DataFrame:
    return group_by(report, label("file"), "path")


def by_directory(report: DataFrame, depth: int = 1) -> DataFrame:
    return group_by(report, label("directory", depth), "directory")


def rows(report: DataFrame, dimension: str = "language", depth: int = 1, families: bool = True) -> DataFrame:
    """(family, label, files, counters): the family is set for the language dimension with ``families``, else null."""
    family = F.col("family") if families and dimension == "language" else F.lit(None).cast("string")
    return report.groupBy(family.alias("family"), label(dimension, depth).alias("label")).agg(F.count("*").alias("files"), *_sums())


def merge(*reports: DataFrame) -> DataFrame:
    """File rows of all reports, nothing dropped."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def sort_key(sort: str) -> Column:
    keys = {
        "code": F.col("impl_code") + F.col("test_code"),
        "comments": F.col("impl_comments") + F.col("test_comments"),
        "blanks": F.col("impl_blanks") + F.col("test_blanks"),
        "test": F.col("test_code"),
        "lines": lines(),
        "name": F.lit(0).cast("long"),
    }
    if sort not in keys:
        raise ValueError(f"unknown sort {sort!r}; one of {', '.join(SORTS)}")
    return keys[sort]


def order(sort: str) -> list[Column]:
    """Largest change first, whichever its sign; then labels in byte order."""
    return [F.abs(sort_key(sort)).desc(), F.col("label"), F.col("family").asc_nulls_first()]


def finish(grouped: DataFrame, sort: str = "code", top: int | None = None) -> DataFrame:
    """Sorted rows, the first ``top`` of them; Spark takes them without sorting all."""
    ordered = grouped.orderBy(*order(sort))
    return ordered if top is None else ordered.limit(top)


def total_row(shown: DataFrame) -> DataFrame:
    """The sum of the rows that are shown."""
    files = F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files")
    return shown.agg(files, *_sums()).select(F.lit(None).cast("string").alias("family"), F.lit(TOTAL).alias("label"), "files", *COUNTERS)


def with_total(shown: DataFrame) -> DataFrame:
    return shown.unionByName(total_row(shown))


def roll_up(shown: DataFrame, sort: str = "code") -> DataFrame:
    """Rows of families, each before its members: (position, kind, family, label, files, counters), kind ``family``, ``member`` or ``last``.

    ``shown`` has one row per label that is displayed, that is as many as there are languages.
    """
    sums = [F.sum(c).cast("long").alias(c) for c in ("files", *COUNTERS)]
    heads = shown.groupBy("family").agg(*sums).withColumn("label", F.col("family"))
    place = Window.orderBy(*order(sort))
    heads = heads.withColumns({"head": F.row_number().over(place), "member": F.lit(0)})
    inside = Window.partitionBy("family").orderBy(*order(sort))
    members = shown.withColumns({"member": F.row_number().over(inside), "of": F.count("*").over(Window.partitionBy("family"))})
    members = members.join(F.broadcast(heads.select("family", "head")), "family")
    kind = F.when(F.col("member") == F.col("of"), "last").otherwise("member")
    both = heads.withColumn("kind", F.lit("family")).unionByName(members.withColumn("kind", kind).drop("of"))
    position = F.row_number().over(Window.orderBy("head", "member")).cast("long")
    return both.withColumn("position", position).select("position", "kind", "family", "label", "files", *COUNTERS)


def test_ratio() -> Column:
    """Test code in all code; null without code."""
    return F.try_divide(F.col("test_code").cast("double"), F.col("impl_code") + F.col("test_code"))


def share(part: Column, whole: Column) -> Column:
    """Per cent, where the part lies within a positive whole."""
    return F.when((whole > 0) & (part >= 0) & (part <= whole), F.lit(100.0) * part / whole)


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, ties to even, or a dash."""
    value = share(part, whole)
    return F.coalesce(F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit("%")), F.lit("—"))


def sort_by_size(report: DataFrame) -> DataFrame:
    """Files by all lines, largest first, then by path."""
    return report.orderBy(lines().desc(), "path")
