"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alerts, auth, processes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**auth.QUERIES, **alerts.QUERIES, **processes.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**auth.ORACLES, **alerts.ORACLES, **processes.ORACLES}
