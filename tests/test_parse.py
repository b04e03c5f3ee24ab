from datetime import datetime

import pytest

from triagemill.operators.parse import parse_syslog, security_events


def parsed(lines, *texts, **options):
    options.setdefault("default_year", 2026)
    return parse_syslog(lines(*texts), **options).orderBy("seq").collect()


def test_failed_password(lines):
    (e,) = parsed(lines, "Mar  3 01:02:03 db sshd[77]: Failed password for invalid user eve from 192.0.2.9 port 4022 ssh2")
    assert (e.kind, e.ts, e.host, e.process, e.pid) == (
        "ssh_failed_password", datetime(2026, 3, 3, 1, 2, 3), "db", "sshd", 77,
    )
    assert (e.fields.user, e.fields.invalid_user, e.fields.ip, e.fields.port) == ("eve", True, "192.0.2.9", 4022)


def test_failed_password_of_valid_user(lines):
    (e,) = parsed(lines, "Mar 13 01:02:03 db sshd[77]: Failed password for eve from 192.0.2.9 port 4022 ssh2")
    assert e.fields.invalid_user is False and e.fields.command is None


def test_accepted(lines):
    (e,) = parsed(lines, "MAR 13 01:02:03 db sshd: Accepted publickey for amy from 192.0.2.1 port 22 ssh2")
    assert (e.kind, e.fields.method, e.fields.user, e.pid) == ("ssh_accepted", "publickey", "amy", None)


def test_sudo_command_is_trimmed(lines):
    (e,) = parsed(lines, "Mar 13 01:02:03 db sudo:  amy : TTY=pts/0 ; PWD=/srv ; USER=root ; COMMAND=/bin/ls -l \t")
    assert (e.kind, e.fields.invoker, e.fields.target_user, e.fields.command) == (
        "sudo_command", "amy", "root", "/bin/ls -l",
    )


def test_useradd_and_crontab(lines):
    a, b = parsed(
        lines,
        "Mar 13 01:02:03 db useradd[5]: new user: name=bob , UID=0, GID=0",
        "Mar 13 01:02:03 db crontab[6]: (bob) BEGIN EDIT (bob)",
    )
    assert (a.kind, a.fields.name, a.fields.uid) == ("useradd", "bob", 0)
    assert (b.kind, b.fields.user, b.fields.action) == ("crontab_replace", "bob", "BEGIN EDIT")


def test_first_class_wins_wherever_it_stands(lines):
    (e,) = parsed(
        lines,
        "Mar 13 01:02:03 db x: (bob) REPLACE Accepted password for a from 1.1.1.1 port 1 "
        "Failed password for b from 2.2.2.2 port 2",
    )
    assert (e.kind, e.fields.user) == ("ssh_failed_password", "b")


def test_other_is_kept_but_not_for_detectors(spark, lines):
    events = parse_syslog(lines("Mar 13 01:02:03 db systemd[1]: Started."), default_year=2026)
    assert [e.kind for e in events.collect()] == ["other"]
    assert security_events(events).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "",
        "   \t",
        "free text",
        "Mar 13 01:02:03 db no colon",
        "Feb 30 01:02:03 db x: y",
        "Feb 29 01:02:03 db x: y",
        "Mar 13 24:02:03 db x: y",
        "Mar 13 01:02:60 db x: y",
        "Xyz 13 01:02:03 db x: y",
        "0000-01-01T00:00:00 db x: y",
        "2026-01-01T00:00:00.5 db x: y",
        "2026-01-01T00:00:00Z db x: y",
        "2026-01-01T00:00:00 db x: y\nz",
    ],
)
def test_dropped(lines, text):
    assert parsed(lines, text) == []


def test_leap_day_in_a_leap_year(lines):
    (e,) = parsed(lines, "Feb 29 01:02:03 db x: y", default_year=2024)
    assert e.ts == datetime(2024, 2, 29, 1, 2, 3)


def test_iso_and_trailing_newline(lines):
    (e,) = parsed(lines, "2020-02-03T04:05:06 db x[9]: y\n\n")
    assert (e.ts, e.raw, e.message) == (datetime(2020, 2, 3, 4, 5, 6), "2020-02-03T04:05:06 db x[9]: y", "y")


def test_time_in_daylight_saving_gap_stays(lines):
    (e,) = parsed(lines, "Mar  8 02:30:00 db x: y")
    assert e.ts == datetime(2026, 3, 8, 2, 30)


def test_carriage_return_does_not_end_a_message(lines):
    (e,) = parsed(lines, "Mar 13 01:02:03 db x: y\rz")
    assert e.message == "y\rz"


def test_year_rollback(lines):
    as_of = datetime(2026, 3, 1)
    texts = ("Feb 28 01:00:00 db x: y", "Mar  2 01:00:00 db x: y", "2030-03-02T01:00:00 db x: y", "2025-03-02T01:00:00 db x: y")
    years = [e.ts.year for e in parsed(lines, *texts, default_year=None, as_of=as_of)]
    assert years == [2026, 2025, 2025, 2025]


def test_rollback_of_leap_day_is_dropped(lines):
    assert parsed(lines, "Feb 29 01:00:00 db x: y", default_year=None, as_of=datetime(2024, 1, 1)) == []
