"""A baseline that grows: versions under manifests, each fingerprint with the times it was first and last seen.

A version is a table in a folder of its own. It counts from the moment its manifest, a small file named by its number,
is there; so a write that fails leaves the version before it in force, and a reader never sees half of one. Two writers
that take the same number cannot both create its manifest: the second one fails and may try again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.baseline import fingerprint


@dataclass(frozen=True)
class Version:
    """A version in force: its number, the folder of its table, and the writer's mark, which tells a retry from news."""

    number: int
    folder: str
    mark: str | None


class ConcurrentUpdate(RuntimeError):
    """Another writer has taken the version number."""


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in its form."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _schema(scope: Sequence[str]) -> str:
    return ", ".join([*(f"{c} STRING" for c in scope), "fingerprint STRING", "first_seen TIMESTAMP_NTZ", "last_seen TIMESTAMP_NTZ"])


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions in the order of their numbers. A manifest that was not written to its end counts for none."""
    found = []
    for number, name in _manifests(spark, path):
        text = spark.read.text(name, wholetext=True).first()
        try:
            held = json.loads(text.value) if text else None
            found.append(Version(number, held["folder"], held["mark"]))
        except (TypeError, KeyError, json.JSONDecodeError):
            continue
    return found


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    fs, folder = _hadoop(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [str(status.getPath().toString()) for status in fs.listStatus(folder)]
    numbered = ((re.search(r"/(\d+)\.json$", name), name) for name in names)
    return sorted((int(m.group(1)), name) for m, name in numbered if m)


def seen(processes: DataFrame, scope: Sequence[str] = (), time: str = "snapshot_ts") -> DataFrame:
    """Each fingerprint with its first and last time; a missing name or path is empty."""
    keys = [*(F.col(c) for c in scope), fingerprint().alias("fingerprint")]
    return processes.fillna("", ["name", "exe"]).groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def update(
    spark: SparkSession, path: str, processes: DataFrame, scope: Sequence[str] = (), mark: str | None = None
) -> int:
    """Merge what the processes show into the latest version, and put the result in force as a new one.

    Returns its number. With a ``mark`` that a version already has, nothing is done: the update was made before.
    """
    known = versions(spark, path)
    done = [v.number for v in known if mark is not None and v.mark == mark]
    if done:
        return done[-1]
    news = seen(processes, scope)
    if known:
        news = news.unionByName(read(spark, path, scope))
    merged = news.groupBy(*scope, "fingerprint").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    keys = [*scope, "fingerprint"]
    folder = f"version-{uuid.uuid4().hex}"
    merged.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/{folder}")
    number = max((n for n, _ in _manifests(spark, path)), default=0) + 1
    _put(spark, f"{path}/manifests/{number:08d}.json", json.dumps({"folder": folder, "mark": mark}))
    return number


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file, which must not be there yet."""
    fs, location = _hadoop(spark, path)
    try:
        out = fs.create(location, False)
    except Exception as problem:
        if "exist" in str(problem).lower():
            raise ConcurrentUpdate(path) from problem
        raise
    out.write(bytearray(text.encode()))
    out.close()


def read(
    spark: SparkSession,
    path: str,
    scope: Sequence[str] = (),
    version: int | None = None,
    without_mark: str | None = None,
) -> DataFrame:
    """``(scope, fingerprint, first_seen, last_seen)`` of a version, the latest if none is named; empty if there is none.

    ``without_mark`` leaves out what a writer with this mark has added, so that a retry meets what the first try met.
    """
    known = [v for v in versions(spark, path) if version in (None, v.number)]
    if without_mark is not None:
        first = next((v.number for v in known if v.mark == without_mark), None)
        known = [v for v in known if first is None or v.number < first]
    if version is not None and not known:
        raise ValueError(f"no version {version} at {path}")
    if not known:
        return spark.createDataFrame([], _schema(scope))
    return spark.read.schema(_schema(scope)).parquet(f"{path}/{known[-1].folder}")


def forget(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Delete all but the latest ``keep`` versions, manifests first; returns the numbers that are gone."""
    gone = versions(spark, path)[: -keep if keep else None]
    for v in gone:
        for name in (f"manifests/{v.number:08d}.json", v.folder):
            fs, location = _hadoop(spark, f"{path}/{name}")
            fs.delete(location, True)
    return [v.number for v in gone]
