"""Logins after failures on a stream: keyed state and event-time timers, each login judged once.

State is kept by address and tile of time, sixteen look-backs long; failures stand in the tile after theirs as well where
logins of it look back on them. So an address is spread over as many tasks as it has tiles. A key holds the number and
the first of its failures for each second, and the logins that wait. Tasks reduce failures to that before they are
shuffled. A login is judged when the watermark has passed it, by two places in the running sums of the seconds, so the
work does not grow with the number of failures before it, nor with the seconds of the look-back. What no login can look
back on any more leaves the state.

Defined results: those of ``compromised_logins`` over all events. Events later than the delay are dropped, events
younger than the watermark wait. Rows that repeat count each time as failures; logins that repeat are one row, and count
each failure as often. ``seq`` is a number. Rows without a file, an address or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as V
from ..functions.time import epoch_seconds, ntz_from_epoch
from ..operators.detect import SCOPE

#: Look-backs of a tile.
LOOK_BACKS = 16
#: Rows that are reduced together.
TOGETHER = 1 << 18
#: Of each second its failures, and the least ``seq``, if one of them has any; of each login the same.
STATE = (
    "seconds array<bigint>, counts array<bigint>, numbered array<boolean>, firsts array<bigint>, "
    "epochs array<bigint>, has array<boolean>, seqs array<bigint>, users array<string>"
)
HIT = f"{SCOPE} string, ip string, epoch bigint, has boolean, seq bigint, user string, prior bigint, first bigint"

Columns = tuple[np.ndarray, ...]


def reduced(seconds: np.ndarray, counts: np.ndarray, numbered: np.ndarray, firsts: np.ndarray) -> Columns:
    """One row for each second, in order: the sum of the counts, and the least number if there is any."""
    order = np.lexsort((firsts, ~numbered, seconds))
    seconds, counts, numbered, firsts = (c[order] for c in (seconds, counts, numbered, firsts))
    new = np.ones(len(seconds), bool)
    new[1:] = seconds[1:] != seconds[:-1]
    (at,) = np.nonzero(new)
    return seconds[at], np.add.reduceat(counts, at) if len(at) else counts, numbered[at], firsts[at]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value from ``low`` to before ``high``, for ranges that are not empty."""
    result = np.empty(len(low), np.int64)
    level = np.frexp(high - low)[1] - 1
    own = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            own = np.minimum(own[: -(1 << (k - 1))], own[1 << (k - 1) :])
        at = level == k
        result[at] = np.minimum(own[low[at]], own[high[at] - (1 << k)])
    return result


def judged(failures: Columns, epochs: np.ndarray, lookback: int) -> tuple[np.ndarray, np.ndarray]:
    """For each login the failures it looks back on, and the second of the one that stands first in the file."""
    seconds, counts, numbered, firsts = failures
    low, high = np.searchsorted(seconds, epochs - lookback), np.searchsorted(seconds, epochs, "right")
    sums = np.append(0, np.cumsum(counts))
    prior, first = sums[high] - sums[low], np.zeros(len(epochs), np.int64)
    # Failures without a number stand before all others.
    order = np.lexsort((seconds, firsts, numbered))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    some = high > low
    first[some] = seconds[order[_least(rank, low[some], high[some])]]
    return prior, first


def _step(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, lookback: int, least: int, width: int
) -> Iterator[pd.DataFrame]:
    kinds = (np.int64, np.int64, bool, np.int64, np.int64, bool, np.int64, object)
    held = [np.array(c, kind) for c, kind in zip(state.get if state.exists else [[]] * 8, kinds)]
    failures, logins = tuple(held[:4]), [held[4:]]
    if not state.hasTimedOut:
        for frame in frames:
            failed = frame["n"].to_numpy() > 0
            columns = [frame[c].to_numpy() for c in ("epoch", "n", "has", "seq", "user")]
            more = [c[failed] for c in columns[:4]]
            failures = reduced(*(np.concatenate(pair).astype(kind) for pair, kind in zip(zip(failures, more), kinds)))
            logins.append([columns[i][~failed] for i in (0, 2, 3, 4)])
    epochs, has, seqs, users = (np.concatenate(c).astype(kind) for c, kind in zip(zip(*logins), kinds[4:]))
    mark = state.getCurrentWatermarkMs() // 1000
    ready = epochs < mark
    if ready.any():
        prior, first = judged(failures, epochs[ready], lookback)
        rows = pd.DataFrame(
            {"epoch": epochs[ready], "has": has[ready], "seq": seqs[ready], "user": users[ready], "prior": prior, "first": first}
        )
        rows = rows[rows["prior"] > 0]
        once = rows.groupby(["epoch", "has", "seq", "user"], dropna=False, sort=False, as_index=False)
        found = once.agg(prior=("prior", "sum"), first=("first", "first"))
        found = found[found["prior"] >= least]
        if len(found):
            found["user"] = found["user"].astype(object).where(found["user"].notna(), None)
            found.insert(0, SCOPE, key[0])
            found.insert(1, "ip", key[1])
            yield found
    epochs, has, seqs, users = (c[~ready] for c in (epochs, has, seqs, users))
    # The youngest login that is still to come, or waits, looks back on what stays; the last of the tile ends it all.
    from_ = min(mark, int(epochs.min(initial=mark)))
    end = (int(key[2]) + 1) * width
    stays = (failures[0] >= from_ - lookback) & (from_ < end)
    failures = tuple(c[stays] for c in failures)
    if not len(epochs) and not len(failures[0]):
        if state.exists:
            state.remove()
        return
    state.update(tuple(c.tolist() for c in (*failures, epochs, has, seqs, users)))
    due = int(epochs.min()) + 1 if len(epochs) else min(end, int(failures[0][-1]) + lookback) + 1
    state.setTimeoutTimestamp(max(due * 1000, state.getCurrentWatermarkMs() + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Failures by address and second, within many rows of a task."""

    def counted() -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(waiting).group_by([SCOPE, "ip", "epoch"]).aggregate([("n", "sum"), ("seq", "min")])
        columns = (found.column(c) for c in (SCOPE, "ip", "epoch", "n_sum", "seq_min"))
        yield from pa.table(list(columns), schema=waiting[0].schema).to_batches()

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= TOGETHER:
            yield from counted()
            waiting = []
    if waiting:
        yield from counted()


def _timed(events: DataFrame, kind: str, delay: str, n: int, user: Column) -> DataFrame:
    """Events of a kind with an address and a time; failures are counted."""
    rows = events.where((F.col("kind") == kind) & F.col("ts").isNotNull()).select(
        F.col(SCOPE).cast("string").alias(SCOPE),
        F.col("fields.ip").alias("ip"),
        epoch_seconds(F.col("ts")).alias("epoch"),
        F.lit(n).cast("bigint").alias("n"),
        F.col("seq").cast("bigint").alias("seq"),
        user.cast("string").alias("user"),
    )
    rows = rows.where(F.col(SCOPE).isNotNull() & F.col("ip").isNotNull())
    if n:
        few = rows.drop("user")
        rows = few.mapInArrow(_count, few.schema).withColumn("user", F.lit(None).cast("string"))
    return rows.withColumn("time", F.timestamp_seconds("epoch")).withWatermark("time", delay)


def watch_compromise(
    events: DataFrame,
    delay: str = "10 minutes",
    lookback_seconds: int = V.COMPROMISE_LOOKBACK_SECONDS,
    min_prior_failures: int = V.COMPROMISE_MIN_FAILURES,
) -> DataFrame:
    """A stream of logins with enough failures before them: ``source_file, seq, ip, user, ts, prior, first_ts``."""
    if min_prior_failures < 1 or lookback_seconds < 0:
        raise ValueError("min_prior_failures must be at least 1 and lookback_seconds at least 0")
    width = LOOK_BACKS * max(lookback_seconds, 60)
    own, following = (F.floor((F.col("epoch") + n) / width).cast("bigint") for n in (0, lookback_seconds))
    # Each kind has a watermark of its own, and the lesser of them counts.
    failed = _timed(events, V.KIND_FAILED, delay, 1, F.lit(None)).withColumn(
        "tile", F.explode(F.array_distinct(F.array(own, following)))
    )
    accepted = _timed(events, V.KIND_ACCEPTED, delay, 0, F.col("fields.user")).withColumn("tile", own)
    columns = (SCOPE, "ip", "tile", "time", "epoch", "n", F.col("seq").isNotNull().alias("has"), F.coalesce("seq", F.lit(0)).alias("seq"), "user")
    both = failed.select(*columns).unionByName(accepted.select(*columns))
    step = partial(_step, lookback=lookback_seconds, least=min_prior_failures, width=width)
    found = both.groupBy(SCOPE, "ip", "tile").applyInPandasWithState(
        step, HIT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(
        SCOPE, F.when(F.col("has"), F.col("seq")).cast(events.schema["seq"].dataType).alias("seq"), "ip", "user",
        ntz_from_epoch(F.col("epoch")).alias("ts"), "prior", ntz_from_epoch(F.col("first")).alias("first_ts"),
    )
