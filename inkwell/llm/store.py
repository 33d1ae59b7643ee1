"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes the shuffle files of a query at its end; what was written does not need them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of local applications that name none.
_own: dict[str, str] = {}


class Table(NamedTuple):
    """A written table: ``frame`` reads it, ``drop`` empties it once nothing reads it any more."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        if self in _kept:
            _kept.remove(self)
        self.frame.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(self.path)


#: Tables that still have their rows.
_kept: list[Table] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only where that is unset on a local master (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="inkwell-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


@contextmanager
def _released(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write(frame: DataFrame, label: str) -> Table:
    """Write ``frame`` once as Parquet in the shared folder.

    Later steps read the files, so nothing upstream runs twice and a lost executor costs a reread only.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _released(spark):
        frame.write.parquet(path)
    table = Table(spark.read.schema(frame.schema).parquet(path), path)
    _kept.append(table)
    return table


def cut(frame: DataFrame, label: str) -> DataFrame:
    """``write``, for tables that a lazy result goes on reading; they are removed by ``sweep``."""
    return write(frame, label).frame


@contextmanager
def sweep():
    """Drops the tables made inside the block when it ends, except those made by ``keep``, which it yields in place of ``write``."""
    before, spared = len(_kept), []

    def keep(frame: DataFrame, label: str) -> DataFrame:
        spared.append(write(frame, label))
        return spared[-1].frame

    yield keep
    for table in _kept[before:]:
        if table not in spared:
            table.drop()


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` names it.

    Inside a higher-order function a column expression would be computed anew for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
