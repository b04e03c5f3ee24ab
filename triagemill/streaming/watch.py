"""Watch mode: match and diff every new snapshot as it arrives.

Matching is stateless and the baseline is a static side, so the stream keeps no state but its file log: a lost
executor costs a task, a lost driver resumes from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.baseline import new_processes, normalized
from ..operators.match import Rule, evaluate
from ..sources import baseline_store
from ..sources.bundled import DEFAULT_RULES
from ..sources.tables import PROCESS_SCHEMA


def snapshot_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PROCESS_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def watch_findings(snapshots: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rule findings of each arriving process."""
    return evaluate(normalized(snapshots), rules)


def watch_new(snapshots: DataFrame, baseline: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Arriving processes the baseline does not know: a stream-static anti join."""
    return new_processes(normalized(snapshots), baseline, scope)


def start(
    stream: DataFrame, path: str, checkpoint: str, every_seconds: int | None = None
) -> StreamingQuery:
    """Append to a parquet table, every so many seconds, or once over all that is there."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if every_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{every_seconds} seconds")
    return writer.start(path)


def start_against_store(
    snapshots: DataFrame,
    store: str,
    path: str,
    checkpoint: str,
    scope: Sequence[str] = (),
    learn: bool = False,
    every_seconds: int | None = None,
) -> StreamingQuery:
    """Diff each batch of snapshots against the baseline that is in force when the batch begins.

    The baseline is read anew for every batch, so an update shows in the next one. Findings of a batch go to a folder
    named by its number, which a retry replaces: it adds nothing. With ``learn`` a batch then updates the baseline, once,
    under a mark made of stream and batch; a retry is judged without its own update. Findings read back by
    :func:`found_new`.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, mark = normalized(batch), f"{checkpoint}#{number}"
        known = baseline_store.read(spark, store, scope, without_mark=mark)
        new_processes(rows, known, scope).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if learn:
            baseline_store.update(spark, store, rows, scope, mark)

    writer = snapshots.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    if every_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{every_seconds} seconds")
    return writer.start()


def found_new(spark: SparkSession, path: str) -> DataFrame:
    """All processes that :func:`start_against_store` has found, with the number of their batch."""
    return spark.read.parquet(path)
