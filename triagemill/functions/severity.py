"""Severity ranks and weights as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(col: Column, table: Mapping) -> Column:
    """Literal lookup; an unknown key gives null."""
    result = None
    for key, value in table.items():
        result = F.when(col == key, value) if result is None else result.when(col == key, value)
    return result.otherwise(F.lit(None))
