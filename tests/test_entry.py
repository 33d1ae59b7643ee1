"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry
from inkwell import oracles, queries


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.queries()) == set(oracles.oracle_sql())


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns[:3] == ["family", "label", "files"] and got.count() > 5
