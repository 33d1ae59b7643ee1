"""Written tables: where they go, and when they are emptied."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkwell.llm import store


def test_tables_are_written_and_dropped(spark):
    table = store.write(spark.range(5).withColumn("x", F.lit("a")), "test")
    assert table.path.startswith(store.shared_folder(spark)) and table.frame.count() == 5 and table in store._kept
    table.drop()
    assert table not in store._kept and spark.read.schema(table.frame.schema).parquet(table.path).count() == 0


def test_sweep_drops_all_but_what_is_kept(spark):
    before = len(store._kept)
    with store.sweep() as keep:
        inner = store.cut(spark.range(3), "inner")
        kept = keep(inner.withColumn("y", F.lit(1)), "kept")
    assert kept.count() == 3 and len(store._kept) == before + 1


def test_the_setting_is_put_back(spark):
    assert spark.conf.get(store.CLEANUP, "false") == "false"
    with pytest.raises(Exception):
        store.write(spark.range(1).select(F.raise_error(F.lit("no"))), "bad")
    assert spark.conf.get(store.CLEANUP, "false") == "false"


def test_a_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(cluster)


def test_bound_values_are_computed_once(spark):
    frame = spark.range(3).select(store.bind(F.rand(7), lambda r: F.struct(r.alias("a"), r.alias("b"))).alias("s"))
    assert frame.where("s.a <> s.b").isEmpty()
