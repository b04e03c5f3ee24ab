"""The look-back on a stream: no login meets the failures before it one by one, and rows that repeat or lack a value."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from triagemill.functions.time import ntz_from_epoch
from triagemill.streaming import look_back, watch

START = 1_704_067_200
SCHEMA = "source_file string, seq bigint, epoch bigint, kind string, fields struct<ip: string, user: string>"
FAILED, ACCEPTED = "ssh_failed_password", "ssh_accepted"


def expected(rows, seconds, least):
    """By plain loops: repeated logins are one row that counts each failure as often; no number stands first."""
    found = []
    for (file, seq, at, kind, (ip, user)), times in Counter(r for r in rows if r[3] == ACCEPTED).items():
        before = [(r[1] is not None, r[1] or 0, r[2]) for r in rows if r[3] == FAILED and (r[0], r[4][0]) == (file, ip) and at - seconds <= r[2] <= at]
        if None in (file, ip) or not before or len(before) * times < least:
            continue
        by_second = {}
        for b in before:
            by_second.setdefault(b[2], []).append(b)
        # The least number of each second; a second without any stands first.
        first = min(min((b for b in own if b[0]), default=own[0]) for own in by_second.values())
        found.append((file, seq, ip, user, at, len(before) * times, first[2]))
    return sorted(found, key=repr)


def test_one_address_with_many_failures_and_logins(spark, tmp_path):
    r = random.Random(3)
    rows = [("a", r.randrange(10**6), START + r.randrange(4000), r.choice([FAILED, FAILED, ACCEPTED]), ("1.1.1.1", r.choice("uv"))) for _ in range(3000)]
    rows += [(r.choice(["a", None]), r.choice([None, 2**60 + 1, 5]), START + r.randrange(300), r.choice([FAILED, ACCEPTED]), (r.choice(["2.2.2.2", None]), r.choice(["u", None]))) for _ in range(400)]
    rows += rows[:40] + rows[-100:]
    end = [("z", 1, START + 10**6, kind, ("0.0.0.0", "x")) for kind in (FAILED, ACCEPTED)]
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    events = spark.createDataFrame(rows + end, SCHEMA).withColumn("ts", ntz_from_epoch(F.col("epoch"))).drop("epoch")
    events.repartition(3).write.parquet(folder)
    stream = look_back.watch_compromise(spark.readStream.schema(events.schema).parquet(folder), "5 minutes", 120, 3)
    query = watch.start(stream, out, progress)
    query.awaitTermination()
    epoch = {name: F.unix_timestamp(F.col(name).cast("string")).alias(name) for name in ("ts", "first_ts")}
    zone = int(spark.sql("select unix_timestamp('2024-01-01 00:00:00') u").first().u) - START
    got = spark.read.parquet(out).select("source_file", "seq", "ip", "user", epoch["ts"] - zone, "prior", epoch["first_ts"] - zone)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, 120, 3) and got.count() > 1000
    # State is kept by tile of an address: it has no row for each login, and no join goes through the failures.
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert {o["operatorName"] for o in operators} == {"applyInPandasWithState"}
    assert max(o["numRowsTotal"] for o in operators) <= 12


def test_sums_and_first_failures_of_any_stretch():
    r = random.Random(5)
    for n in (0, 1, 7, 300):
        raw = [(r.randrange(200), r.randrange(1, 4), r.random() < 0.7, r.randrange(50)) for _ in range(n)]
        columns = [np.array(c, k) for c, k in zip(zip(*raw) if raw else [()] * 4, (np.int64, np.int64, bool, np.int64))]
        failures = look_back.reduced(*columns)
        assert failures[0].tolist() == sorted({x[0] for x in raw}) and failures[1].sum() == sum(x[1] for x in raw)
        at = np.arange(-5, 220)
        prior, first = look_back.judged(failures, at, 20)
        seconds = list(zip(*(c.tolist() for c in failures)))
        for t, p, f in zip(at, prior, first):
            own = [(has, number, s, many) for s, many, has, number in seconds if t - 20 <= s <= t]
            assert p == sum(x[3] for x in own) and (not own or f == min(own)[2])
