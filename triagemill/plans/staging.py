"""Intermediate tables in the cluster's shared folder.

A staged table is written once and read back. It cuts the lineage, outlives lost executors, keeps a parse from being
repeated by every reader, and gives the optimizer a true size to decide broadcasts on. A staged table lives until
``release`` is called, which is for the end of a run: results that are read lazily still need their tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Without one, a single machine in local mode gets a folder of its own, once per application; a cluster gets an error.
    """
    context = spark.sparkContext
    named = context.getConf().get(FOLDER_SETTING) or spark.conf.get(FOLDER_SETTING, None)
    if named:
        return named.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise ValueError(f"set {FOLDER_SETTING} to a folder all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="triagemill-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` and read it back. Columns of ``partition_by`` become folders that readers can skip.

    With folders, rows are rebalanced on their columns first: a folder gets files of the advisory size, not one from
    every task, and a large folder is written by several tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> int:
    """Delete the tables this application has staged so far, and return how many there were."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(hadoop).delete(location, True)
    return len(paths)
