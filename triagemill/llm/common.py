"""Helpers shared by the operators: tables, Arrow batches, word characters."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, as Java's regular expressions write it.
WHITE = r"[\x20\x09-\x0D]"
#: A-Z to a-z on UTF-8 bytes; bytes beyond ASCII stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers that start later find this package where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, the only knob that sizes the hash buckets of the operators."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if b is None else b for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most_bytes``; a longer text makes a run of its own."""
    sizes = batch.column(column).cast(pa.binary())
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(sizes).to_pylist()], dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def int64_array(values) -> pa.Array:
    return pa.array(values, pa.int64())


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many lines behind it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row; maps, which Spark does not hash, by what they print as."""
    return F.xxhash64(*(F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes))
