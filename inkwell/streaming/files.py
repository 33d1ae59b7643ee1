"""Files that arrive as a stream: each is counted by itself, so the batch operators apply without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkwell.operators import files, report


def counted(stream: DataFrame, options: files.Options | None = None) -> DataFrame:
    """The file rows of a streaming frame with ``path`` and ``content``; append mode."""
    return files.report(stream, options)


def running(stream: DataFrame, dimension: str = "language", options: files.Options | None = None) -> DataFrame:
    """Running counters by a dimension; complete or update mode. State is one row per label."""
    return report.rows(counted(stream, options), dimension, families=False)
