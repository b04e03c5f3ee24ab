import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from triagemill.operators import detect
from triagemill.operators.parse import parse_syslog

START = datetime(2026, 1, 10, 3, 0, 0)


def at(seconds):
    return (START + timedelta(seconds=seconds)).isoformat()


def failed(seconds, ip="192.0.2.7", user="root"):
    return f"{at(seconds)} h sshd[1]: Failed password for {user} from {ip} port 1 ssh2"


def accepted(seconds, ip="192.0.2.7", user="root"):
    return f"{at(seconds)} h sshd[1]: Accepted password for {user} from {ip} port 1 ssh2"


def sudo(seconds, user="root"):
    return f"{at(seconds)} h sudo: amy : TTY=pts/0 ; PWD=/ ; USER={user} ; COMMAND=/bin/sh"


@pytest.fixture
def events(lines):
    return lambda *texts: parse_syslog(lines(*texts), default_year=2026)


def test_brute_force_cluster(events):
    (f,) = detect.brute_force(events(*(failed(8 * i, user=f"u{i % 2}") for i in range(7)))).collect()
    assert (f.severity, f.evidence.attempt_count, f.evidence.users_targeted) == ("HIGH", 5, ["u0", "u1"])
    assert (f.first_seen, f.last_seen, f.seq) == (START, START + timedelta(seconds=32), 0)


@pytest.mark.parametrize("count, step, hits", [(3, 8, 0), (5, 30, 0), (5, 15, 1), (5, 16, 0), (5, 0, 1)])
def test_brute_force_edges(events, count, step, hits):
    assert detect.brute_force(events(*(failed(step * i) for i in range(count)))).count() == hits


def test_compromise(events):
    rows = detect.compromise_after_brute_force(events(*(failed(5 * i) for i in range(4)), accepted(30), accepted(40)))
    assert [(r.evidence.prior_failed_attempts, r.first_seen) for r in rows.collect()] == [(4, START)] * 2


def test_compromise_at_the_same_instant_and_in_file_order(events):
    (f,) = detect.compromise_after_brute_force(events(accepted(50), failed(50), failed(20), failed(30))).collect()
    assert f.evidence.prior_failed_attempts == 3
    assert f.first_seen == START + timedelta(seconds=50)


@pytest.mark.parametrize("gap, hits", [(120, 1), (121, 0)])
def test_compromise_window_is_inclusive(events, gap, hits):
    assert detect.compromise_after_brute_force(events(*[failed(0)] * 3, accepted(gap))).count() == hits


def test_escalation_needs_root_and_correlates_by_time_only(events):
    frame = events(*[failed(0)] * 3, accepted(10), sudo(610), sudo(611), sudo(60, "ubuntu"), sudo(9))
    suspects = detect.suspect_seconds(frame).withColumnRenamed("ts", "last_seen")
    found = detect.privilege_escalation(frame, suspects).orderBy("seq").collect()
    assert [f.severity for f in found] == ["CRITICAL", "MEDIUM", "MEDIUM"]
    assert {f.severity for f in detect.privilege_escalation(frame).collect()} == {"MEDIUM"}


def test_persistence(events):
    frame = events(
        f"{at(1)} h useradd[1]: new user: name=evil, UID=0, GID=0",
        f"{at(2)} h useradd[1]: new user: name=good, UID=1001, GID=1",
        f"{at(3)} h crontab[1]: (bob) REPLACE (bob)",
        f"{at(4)} h crontab[1]: (bob) BEGIN EDIT (bob)",
    )
    found = detect.persistence(frame).orderBy("seq").collect()
    assert [(f.type, f.severity) for f in found] == [
        ("persistence_root_account", "CRITICAL"), ("persistence_crontab", "MEDIUM"),
    ]


def test_report_order(events):
    frame = events(sudo(32), *(failed(8 * i) for i in range(5)), accepted(33), sudo(0))
    ordered = detect.all_findings(frame).orderBy(*detect.ORDER_KEYS).collect()
    assert [f.type for f in ordered] == [
        "brute_force", "compromise_after_brute_force", "privilege_escalation", "privilege_escalation",
    ]


def test_bad_parameters(events):
    frame = events(failed(0))
    for call in (
        lambda: detect.brute_force(frame, threshold=0),
        lambda: detect.brute_force(frame, window_seconds=-1),
        lambda: detect.compromised_logins(frame, min_prior_failures=0),
    ):
        with pytest.raises(ValueError):
            call()


def random_history(rng, count, span):
    rows = []
    for seq in range(count):
        kind = rng.choice(["failed", "failed", "accepted", "sudo"])
        rows.append((rng.choice(["f1", "f2"]), seq, START + timedelta(seconds=rng.randrange(span)), kind, rng.choice("ab"), f"u{rng.randrange(3)}"))
    return rows


def as_events(spark, rows):
    names = {"failed": "ssh_failed_password", "accepted": "ssh_accepted", "sudo": "sudo_command"}
    shaped = [
        (f, s, t, names[k], (u, None, ip, None, None, "amy", "root", "sh", None, None, None)) for f, s, t, k, ip, u in rows
    ]
    fields = (
        "user STRING, invalid_user BOOLEAN, ip STRING, port INT, method STRING, invoker STRING, target_user STRING, "
        "command STRING, name STRING, uid BIGINT, action STRING"
    )
    types = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in fields.split(", ")))
    return spark.createDataFrame(
        shaped, f"source_file string, seq long, ts timestamp_ntz, kind string, fields struct<{types}>"
    )


@pytest.mark.parametrize("seed, window, threshold", [(1, 60, 5), (2, 10, 3), (3, 0, 2), (4, 300, 9), (5, 1, 1)])
def test_brute_force_against_a_plain_scan(spark, seed, window, threshold):
    rng = random.Random(seed)
    rows = random_history(rng, 600, rng.choice([400, 3000]))
    groups = defaultdict(list)
    for f, s, t, kind, ip, user in rows:
        if kind == "failed":
            groups[f, ip].append((t, s, user))
    expected = set()
    for (f, ip), attempts in groups.items():
        attempts.sort()
        for end, (t, _, _) in enumerate(attempts):
            inside = [a for a in attempts[: end + 1] if (t - a[0]).total_seconds() <= window]
            if len(inside) >= threshold:
                expected.add((f, ip, inside[0][0], t, tuple(sorted({a[2] for a in inside}))))
                break
    found = detect.brute_force_clusters(as_events(spark, rows), window, threshold).collect()
    assert {(r.source_file, r.ip, r.first_ts, r.last_ts, tuple(r.users)) for r in found} == expected


@pytest.mark.parametrize("seed, lookback, least", [(1, 120, 3), (2, 0, 1), (3, 30, 2), (4, 100000, 4)])
def test_compromise_against_all_pairs(spark, seed, lookback, least):
    rows = random_history(random.Random(seed), 400, 100000 if seed % 2 else 900)
    expected = set()
    for f, s, t, kind, ip, user in rows:
        if kind == "accepted":
            prior = [
                (s2, t2) for f2, s2, t2, k2, ip2, _ in rows
                if k2 == "failed" and (f2, ip2) == (f, ip) and 0 <= (t - t2).total_seconds() <= lookback
            ]
            if len(prior) >= least:
                expected.add((f, s, len(prior), min(prior)[1]))
    found = detect.compromised_logins(as_events(spark, rows), lookback, least).collect()
    assert {(r.source_file, r.seq, r.prior, r.first_ts) for r in found} == expected


@pytest.mark.parametrize("seed, seconds", [(1, 600), (2, 0), (3, 7), (4, 61)])
def test_near_prior_against_all_pairs(spark, seed, seconds):
    rows = random_history(random.Random(seed), 300, 20000)
    frame = as_events(spark, rows)
    instants = frame.where("kind = 'ssh_accepted'").select("source_file", F.col("ts").alias("instant"))
    expected = {
        (f, s): any(k2 == "accepted" and f2 == f and 0 <= (t - t2).total_seconds() <= seconds for f2, _, t2, k2, _, _ in rows)
        for f, s, t, kind, _, _ in rows if kind == "sudo"
    }
    found = detect.flag_near_prior(detect.root_sudo(frame), instants, seconds).collect()
    assert {(r.source_file, r.seq): r.correlated for r in found} == expected
    assert len(found) == len(expected)
