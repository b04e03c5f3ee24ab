"""Fingerprints of processes and what is new against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(processes: DataFrame) -> DataFrame:
    """Snapshot rows with the blanks filled: missing text is empty, a missing command line has no words."""
    fills = {
        "name": F.lit(""),
        "exe": F.lit(""),
        "cmdline": F.array().cast("array<string>"),
        "username": F.lit(""),
        "create_time": F.lit(0.0),
    }
    return processes.withColumns({c: F.coalesce(F.col(c), fill) for c, fill in fills.items()})


def fingerprint() -> Column:
    """An identity that survives a restart: name and path, no pid."""
    return F.concat(F.col("name"), F.lit(":"), F.col("exe"))


def fingerprints(processes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The distinct fingerprints, per scope if one is given."""
    return processes.select(*scope, fingerprint().alias("fingerprint")).distinct()


def new_processes(processes: DataFrame, baseline: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Processes whose fingerprint the baseline lacks; repeated rows stay repeated."""
    keys = [*scope, "fingerprint"]
    return processes.withColumn("fingerprint", fingerprint()).join(baseline.select(*keys), keys, "left_anti")
