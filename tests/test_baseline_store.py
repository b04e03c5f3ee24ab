"""A baseline that grows, and a watch that reads it anew for every batch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from triagemill.operators.baseline import new_processes, normalized
from triagemill.sources import baseline_store
from triagemill.sources.tables import PROCESS_SCHEMA
from triagemill.streaming import watch


def snapshot(spark, hour, *names, host="h"):
    ts = datetime(2024, 1, 1, hour)
    return spark.createDataFrame([(host, ts, i, i, n, None, None, None, None) for i, n in enumerate(names)], PROCESS_SCHEMA)


def rows(df):
    return sorted((r.fingerprint, r.first_seen.hour, r.last_seen.hour) for r in df.collect())


def test_versions_grow_and_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    assert rows(baseline_store.read(spark, path)) == [] and baseline_store.versions(spark, path) == []
    assert baseline_store.update(spark, path, snapshot(spark, 3, "a", "b", "a", None)) == 1
    assert baseline_store.update(spark, path, snapshot(spark, 1, "b", "c")) == 2
    assert rows(baseline_store.read(spark, path, version=1)) == [(":", 3, 3), ("a:", 3, 3), ("b:", 3, 3)]
    assert rows(baseline_store.read(spark, path)) == [(":", 3, 3), ("a:", 3, 3), ("b:", 1, 3), ("c:", 1, 1)]
    asked = normalized(snapshot(spark, 5, "c", "d", "d"))
    new = {v: [r.name for r in new_processes(asked, baseline_store.read(spark, path, version=v)).collect()] for v in (1, 2)}
    assert new == {1: ["c", "d", "d"], 2: ["d", "d"]}
    with pytest.raises(ValueError):
        baseline_store.read(spark, path, version=9)
    assert baseline_store.forget(spark, path, 1) == [1]
    assert [v.number for v in baseline_store.versions(spark, path)] == [2]
    assert baseline_store.update(spark, path, snapshot(spark, 7, "e")) == 3


def test_a_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    baseline_store.update(spark, path, snapshot(spark, 1, "a"))
    with pytest.raises(Exception, match="boom|DIVIDE|raise"):
        baseline_store.update(spark, path, snapshot(spark, 2, "b").withColumn("exe", F.raise_error(F.lit("boom"))))
    assert rows(baseline_store.read(spark, path)) == [("a:", 1, 1)]
    # A manifest that was cut off counts for nothing, and its number is not used again.
    (tmp_path / "store/manifests/00000002.json").write_text('{"folder": "ver')
    assert rows(baseline_store.read(spark, path)) == [("a:", 1, 1)]
    assert baseline_store.update(spark, path, snapshot(spark, 2, "b")) == 3
    # Another writer is quicker.
    monkeypatch.setattr(baseline_store, "_manifests", lambda *_: [(2, str(tmp_path / "store/manifests/00000002.json"))])
    with pytest.raises(baseline_store.ConcurrentUpdate):
        baseline_store.update(spark, path, snapshot(spark, 2, "c"))
    monkeypatch.undo()
    assert rows(baseline_store.read(spark, path)) == [("a:", 1, 1), ("b:", 2, 2)]


def test_scopes_and_marks(spark, tmp_path):
    path = str(tmp_path / "store")
    both = snapshot(spark, 1, "a", host="x").unionByName(snapshot(spark, 1, "b", host="y"))
    assert baseline_store.update(spark, path, both, ["host"], mark="s#0") == 1
    assert baseline_store.update(spark, path, both, ["host"], mark="s#0") == 1
    assert baseline_store.update(spark, path, snapshot(spark, 2, "c", host="x"), ["host"], mark="s#1") == 2
    assert {(r.host, r.fingerprint) for r in baseline_store.read(spark, path, ["host"]).collect()} == {("x", "a:"), ("y", "b:"), ("x", "c:")}
    before = baseline_store.read(spark, path, ["host"], without_mark="s#1").collect()
    assert {(r.host, r.fingerprint) for r in before} == {("x", "a:"), ("y", "b:")}
    assert baseline_store.read(spark, path, ["host"], without_mark="s#0").collect() == []


def test_watch_sees_updates_and_survives_retries(spark, tmp_path):
    folder, store, out, progress = (str(tmp_path / n) for n in ("in", "store", "out", "progress"))

    def arrive(hour, *names):
        snapshot(spark, hour, *names).coalesce(1).write.mode("append").parquet(folder)
        watch.start_against_store(watch.snapshot_stream(spark, folder), store, out, progress).awaitTermination()
        return sorted((r.batch, r.name) for r in watch.found_new(spark, out).collect())

    baseline_store.update(spark, store, snapshot(spark, 0, "a"))
    assert arrive(1, "a", "b") == [(0, "b")]
    # The baseline changes while the stream is down or between two batches: the next batch knows.
    baseline_store.update(spark, store, snapshot(spark, 1, "b"))
    assert arrive(2, "b", "c", "c") == [(0, "b"), (1, "c"), (1, "c")]
    # The last batch is run again, as after a driver that died before it could note the end.
    (tmp_path / "progress/commits/1").unlink()
    (tmp_path / "progress/commits/.1.crc").unlink(missing_ok=True)
    watch.start_against_store(watch.snapshot_stream(spark, folder), store, out, progress).awaitTermination()
    assert sorted((r.batch, r.name) for r in watch.found_new(spark, out).collect()) == [(0, "b"), (1, "c"), (1, "c")]


def test_a_retry_does_not_know_what_it_has_learned_itself(spark, tmp_path):
    folder, store, out, progress = (str(tmp_path / n) for n in ("in", "store", "out", "progress"))
    snapshot(spark, 1, "a", "b").write.parquet(folder)

    def run():
        stream = watch.snapshot_stream(spark, folder)
        watch.start_against_store(stream, store, out, progress, learn=True).awaitTermination()
        return sorted((r.batch, r.name) for r in watch.found_new(spark, out).collect())

    assert run() == [(0, "a"), (0, "b")]
    (tmp_path / "progress/commits/0").unlink()
    (tmp_path / "progress/commits/.0.crc").unlink(missing_ok=True)
    assert run() == [(0, "a"), (0, "b")]
    assert [v.number for v in baseline_store.versions(spark, store)] == [1]
