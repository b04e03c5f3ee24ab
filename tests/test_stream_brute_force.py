"""Detectors on a stream: the findings of the batch detectors, however the events are cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from triagemill.functions.time import ntz_from_epoch
from triagemill.operators.detect import brute_force_clusters, compromised_logins
from triagemill.streaming import brute_force, look_back, watch

START = 1_704_067_200
SCHEMA = "source_file string, seq bigint, epoch bigint, kind string, fields struct<ip: string, user: string>"


def failures(r, n):
    """Bursts and single failures of a few addresses, one of them with a third of all rows."""
    rows, t = [], START
    for i in range(n):
        t += r.choice([0, 0, 0, 0, 0, 1, 1, 3, 30])
        ip = "203.0.113.5" if r.random() < 0.3 else f"198.51.100.{r.randrange(12)}"
        rows.append((r.choice(["a", "b"]), i, t - r.choice([0, 0, 5, 20]), r.choice(["ssh_failed_password"] * 5 + ["ssh_accepted"]), (ip, r.choice("uvwxyz"))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", ntz_from_epoch(F.col("epoch"))).drop("epoch")


def found(df):
    return sorted((x.source_file, x.ip, x.first_ts, x.last_ts, tuple(x.users)) for x in df.collect())


def run_in_parts(spark, tmp_path, r, rows, stream_of):
    """All that a stream gives for the rows in parts; each run is a restart from the checkpoint."""
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    # The last events only move the watermark on.
    end = [("z", 10**6 + i, rows[-1][2] + 10**6, kind, ("0.0.0.0", "x")) for i, kind in enumerate(("ssh_failed_password", "ssh_accepted"))]
    for part in [rows[:1]] + [rows[a:b] for a, b in ((1, 90), (90, 100), (100, 300), (300, 400))] + [end]:
        r.shuffle(part)
        frame(spark, part).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame(spark, rows[:1]).schema).parquet(folder)
        watch.start(stream_of(stream), out, progress).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("window, threshold", [(60, 5), (0, 2), (300, 1)])
def test_same_as_batch_over_random_batches(spark, tmp_path, window, threshold):
    r = random.Random(window)
    rows = failures(r, 400)
    got = found(run_in_parts(spark, tmp_path, r, rows, lambda s: brute_force.watch_brute_force(s, "5 minutes", window, threshold)))
    expected = found(brute_force_clusters(frame(spark, rows), window, threshold))
    assert got == expected and got
    assert len({x[:2] for x in got}) == len(got)


def test_only_the_first_of_a_second_are_kept():
    rows = [(1, i, "u") for i in range(9, -1, -1)] + [(2, 0, "v"), (2, 0, None)]
    assert brute_force.reduced(rows, 3) == [(1, 0, "u"), (1, 1, "u"), (1, 2, "u"), (2, 0, "v"), (2, 0, None)]
    assert brute_force.first_cluster([(0, 0, "a"), (70, 1, "a"), (80, 2, "b")], 60, 2, 0) == (1, 3)
    assert brute_force.first_cluster([(0, 0, "a")], 60, 2, 0) is None


@pytest.mark.parametrize("seconds, least", [(120, 3), (10, 1)])
def test_look_back_same_as_batch_over_random_batches(spark, tmp_path, seconds, least):
    r = random.Random(seconds)
    rows = failures(r, 400)
    columns = ["source_file", "seq", "ip", "user", "ts", "prior", "first_ts"]
    got = run_in_parts(spark, tmp_path, r, rows, lambda s: look_back.watch_compromise(s, "5 minutes", seconds, least))
    expected = compromised_logins(frame(spark, rows), seconds, least)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))
    assert expected.count() > 3
