"""Helpers for column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` names it.

    A column that is named twice inside a condition or a higher-order function is computed twice; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
