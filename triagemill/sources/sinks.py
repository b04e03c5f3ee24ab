"""Writers of report rows.

A report is a long table of lines, because one log file or host may hold a large part of all findings and no task can
carry that as one string. Ranges of (scope, place) are sorted in parallel; reading the files in name order gives each
report whole and in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def in_order(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_lines(lines: DataFrame, keys: Sequence[str], path: str, line: str = "line") -> None:
    """Write the lines of all reports as text, in order."""
    in_order(lines, keys).select(line).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON object per row; nulls are written, so every report has all its keys.

    Readers open files of a ``compression`` such as gzip by their names. They do not split them; each has what one task
    has written.
    """
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)
