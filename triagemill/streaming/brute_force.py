"""Brute force on a stream of events: keyed state and event-time timers, each address reported once.

Batches may cut the stream anywhere and bring events in any order within the watermark's delay. A failure is looked at
when the watermark has passed its second, so that none before it can still come; by then the failures of an address are
in the order of the batch detector, and the first cluster found is the same. Of one second only the ``threshold`` failures
that stand first in the file can be part of it, so an address holds at most ``threshold`` failures for each second of the
delay, however many arrive, and tasks reduce their rows to that before they are shuffled.

Defined results: events later than the delay are dropped by the watermark. Failures younger than the watermark wait for
later events; the end of a file does not pass judgement. The state of an address is deleted once all its failures are
older than the window, unless it was reported: then a mark stays, so that it is not reported again. ``seq`` is a number;
events without one or without a time are left out, and rows that repeat count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as V
from ..functions.time import epoch_seconds, ntz_from_epoch
from ..operators.detect import SCOPE

STATE = "reported boolean, epochs array<bigint>, seqs array<bigint>, users array<string>, seen int"
HIT = f"{SCOPE} string, ip string, first bigint, last bigint, users array<string>"

Failure = tuple[int, int, str]


def first_cluster(failures: list[Failure], window: int, threshold: int, from_: int) -> tuple[int, int] | None:
    """Of failures in order: bounds of the first ``threshold`` in a row within the window that end at ``from_`` or later."""
    for end in range(max(from_, threshold - 1), len(failures)):
        start = end - threshold + 1
        if failures[end][0] - failures[start][0] <= window:
            return start, end + 1
    return None


def reduced(failures: list[Failure], threshold: int) -> list[Failure]:
    """In order, and of each second only the first ``threshold``."""
    kept: list[Failure] = []
    for f in sorted(failures, key=lambda f: f[:2]):
        if len(kept) < threshold or kept[-threshold][0] != f[0]:
            kept.append(f)
    return kept


def _step(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, window: int, threshold: int
) -> Iterator[pd.DataFrame]:
    reported, epochs, seqs, users, seen = state.get if state.exists else (False, [], [], [], 0)
    if reported:
        for _ in frames:
            pass
        return
    # The first ``seen`` have been looked at and stay as the start of what may follow.
    failures = list(zip(epochs, seqs, users))
    old, waiting = failures[:seen], failures[seen:]
    if not state.hasTimedOut:
        for frame in frames:
            waiting = reduced(waiting + list(zip(frame["epoch"].tolist(), frame["seq"].tolist(), frame["user"].tolist())), threshold)
    mark = state.getCurrentWatermarkMs() // 1000
    ready = sum(f[0] < mark for f in waiting)
    failures, seen = old + waiting, len(old) + ready
    hit = first_cluster(failures[:seen], window, threshold, len(old))
    if hit:
        part = failures[hit[0] : hit[1]]
        state.update((True, [], [], [], 0))
        yield pd.DataFrame(
            {SCOPE: [key[0]], "ip": [key[1]], "first": [part[0][0]], "last": [part[-1][0]], "users": [sorted({f[2] for f in part if f[2] is not None})]}
        )
        return
    # Of those that were looked at, the last few can still be the start of a cluster.
    failures = failures[max(0, seen - threshold + 1) :]
    seen = min(seen, threshold - 1)
    young = next((i for i in range(seen) if failures[i][0] + window >= mark), seen)
    failures, seen = failures[young:], seen - young
    if not failures:
        state.remove()
        return
    state.update((False, *(list(column) for column in zip(*failures)), seen))
    due = failures[seen][0] + 1 if seen < len(failures) else failures[-1][0] + window + 1
    state.setTimeoutTimestamp(max(due * 1000, state.getCurrentWatermarkMs() + 1))


def _reduce(threshold: int):
    """Within a batch of rows, of each address and second the first ``threshold`` failures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas(date_as_object=False) if batch.num_rows else None
            if rows is None:
                yield batch
                continue
            order = rows.sort_values([SCOPE, "ip", "epoch", "seq"], kind="stable")
            nth = order.groupby([SCOPE, "ip", "epoch"], dropna=False, sort=False).cumcount()
            yield batch.take(pa.array(sorted(order.index[nth < threshold].tolist()), pa.int64()))

    return run


def watch_brute_force(
    events: DataFrame,
    delay: str = "10 minutes",
    window_seconds: int = V.BRUTE_FORCE_WINDOW_SECONDS,
    threshold: int = V.BRUTE_FORCE_THRESHOLD,
) -> DataFrame:
    """A stream of the rows that ``brute_force_clusters`` gives for all events: ``source_file, ip, first_ts, last_ts, users``."""
    if threshold < 1 or window_seconds < 0:
        raise ValueError("threshold must be at least 1 and window_seconds at least 0")
    failures = events.where(F.col("kind") == V.KIND_FAILED).select(
        SCOPE,
        F.col("fields.ip").alias("ip"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("fields.user").alias("user"),
        epoch_seconds(F.col("ts")).cast("bigint").alias("epoch"),
    ).where("seq is not null and epoch is not null")
    few = failures.mapInArrow(_reduce(threshold), failures.schema)
    timed = few.withColumn("time", F.timestamp_seconds("epoch")).withWatermark("time", delay)
    step = partial(_step, window=window_seconds, threshold=threshold)
    found = timed.groupBy(SCOPE, "ip").applyInPandasWithState(step, HIT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        SCOPE, "ip", ntz_from_epoch(F.col("first")).alias("first_ts"), ntz_from_epoch(F.col("last")).alias("last_ts"), "users"
    )
