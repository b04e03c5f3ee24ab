"""A column that is computed once, whatever is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Add ``col`` as ``name`` behind a one-element ``explode``.

    Catalyst moves filters through projections by copying the expressions they use. Behind a generator it cannot, so
    regexes and other costly expressions are not run again for a later filter, explode or lambda.
    """
    return df.select("*", F.explode(F.array(col)).alias(name))
