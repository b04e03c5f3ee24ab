import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from triagemill.operators import score
from triagemill.operators.detect import brute_force_clusters
from triagemill.operators.parse import parse_syslog
from triagemill.plans import alert_triage, auth_triage
from triagemill.plans.staging import FOLDER_SETTING, new_path, release, shared_folder, stage
from triagemill.sources import sinks, tables, text

AT = datetime(2026, 2, 1, 12, 0)
ATTACK = [
    *(f"Jan 10 03:22:{10 + 8 * i} web sshd[{i}]: Failed password for {'invalid user admin' if i < 2 else 'root'} from 203.0.113.5 port {i} ssh2" for i in range(6)),
    "Jan 10 03:23:15 web sshd[7]: Accepted password for root from 203.0.113.5 port 9 ssh2",
    "Jan 10 03:25:40 web sudo: amy : TTY=pts/0 ; PWD=/home/amy ; USER=root ; COMMAND=/bin/sh -c \"id\"",
    "Jan 10 03:27:02 web useradd[8]: new user: name=back, UID=0, GID=0",
    "Jan 10 03:28:11 web crontab[9]: (root) REPLACE (root)",
    "Jan 10 09:00:00 web sshd[10]: Accepted publickey for dev from 198.51.100.20 port 4 ssh2",
    "Jan 10 09:05:00 web sudo: dev : TTY=pts/1 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/true",
]
QUIET = [
    "Jan 10 08:00:05 web sshd[1]: Accepted publickey for amy from 198.51.100.10 port 4 ssh2",
    "Jan 10 12:30:00 web sshd[2]: Failed password for amy from 198.51.100.10 port 4 ssh2",
]


@pytest.fixture
def triage(spark, lines):
    both = lines(*ATTACK, source_file="attack.log").unionByName(lines(*QUIET, source_file="quiet.log"))
    return auth_triage.triage_logs(both, default_year=2026)


def test_summary(triage):
    attack, quiet = triage.summary.orderBy("source_file").collect()
    assert (attack.event_count, attack.total_findings) == (12, 6)
    assert (attack.low, attack.medium, attack.high, attack.critical) == (0, 2, 1, 3)
    assert (attack.risk_score, attack.highest_severity) == (100, "CRITICAL")
    assert (quiet.event_count, quiet.total_findings, quiet.risk_score, quiet.highest_severity) == (2, 0, 0, None)
    assert quiet.narrative.startswith("No security-relevant patterns")
    for words in ("6 finding(s)", "appears to have succeeded", "2 root privilege escalation", "persistence"):
        assert words in attack.narrative


@pytest.mark.parametrize("severities, risk, highest", [("LLC", 60, "CRITICAL"), ("CCCCC", 100, "CRITICAL"), ("LM", 20, "MEDIUM")])
def test_scores(spark, severities, risk, highest):
    names = {"L": ("LOW", 1), "M": ("MEDIUM", 2), "C": ("CRITICAL", 4)}
    rows = [("f", *names[s], "brute_force") for s in severities]
    findings = spark.createDataFrame(rows, "source_file string, severity string, severity_rank int, type string")
    row = score.scope_summary(findings.select("source_file").distinct(), findings).first()
    assert (row.risk_score, row.highest_severity, row.low) == (risk, highest, severities.count("L"))


def test_narrative_is_pluggable(lines):
    events = parse_syslog(lines(*QUIET), default_year=2026)
    told = auth_triage.triage_events(events, summarizer=lambda s: s.withColumn("narrative", F.lit("mine")), staged=False)
    assert told.summary.first().narrative == "mine"


def document(report, name):
    rows = report.where(F.col("source_file") == name).orderBy(*auth_triage.LINE_KEYS)
    return [r.line for r in rows.collect()]


def test_json_report(triage):
    report = auth_triage.json_report(triage, AT)
    doc = json.loads("\n".join(document(report, "attack.log")))
    assert [f["type"] for f in doc["findings"]] == [
        "brute_force", "compromise_after_brute_force", "privilege_escalation", "persistence_root_account",
        "persistence_crontab", "privilege_escalation",
    ]
    assert doc["summary"]["by_severity"] == {"LOW": 0, "MEDIUM": 2, "HIGH": 1, "CRITICAL": 3}
    assert doc["findings"][2]["evidence"]["command"] == '/bin/sh -c "id"'
    assert doc["time_range"] == {"start": "2026-01-10T03:22:10", "end": "2026-01-10T09:05:00"}
    quiet = json.loads("\n".join(document(report, "quiet.log")))
    assert quiet["findings"] == [] and quiet["summary"]["highest_severity"] is None


def test_markdown_report(triage):
    report = auth_triage.markdown_report(triage, AT)
    text_ = "\n".join(document(report, "attack.log"))
    assert text_.startswith("# Incident Triage Report: attack.log\n\nGenerated: 2026-02-01T12:00:00\nEvents analyzed: 12\n")
    assert "  - LOW" not in text_ and "  - MEDIUM: 2\n" in text_ and text_.count("\n### [") == 6
    assert (
        '- Evidence: `{"ip": "203.0.113.5", "attempt_count": 5, "users_targeted": ["admin", "root"], "window_seconds": 60}`'
        in text_
    )
    assert '"command": "/bin/sh -c \\"id\\"", "correlated_with_compromise": true' in text_
    quiet = "\n".join(document(report, "quiet.log"))
    assert "- Highest severity: None\n" in quiet and "No security-relevant patterns detected.\n" in quiet
    assert quiet.index("## Findings") < quiet.index("## Analyst Narrative")


def test_written_report_is_in_order(spark, triage, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_lines(auth_triage.json_report(triage, AT), auth_triage.LINE_KEYS, path)
    parts = sorted((tmp_path / "report").glob("part-*"))
    everything = "".join(p.read_text() for p in parts)
    attack, quiet = everything.split('{"source_file":"quiet.log"')
    assert json.loads(attack)["summary"]["total_findings"] == 6
    assert json.loads('{"source_file":"quiet.log"' + quiet)["findings"] == []


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("\n".join(ATTACK).encode() + b"\nJan 10 10:00:00 web x: \xff bad\n")
    (tmp_path / "b.log").write_text("\n".join(QUIET))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        events = parse_syslog(text.read_syslog(spark, str(tmp_path)), default_year=2026).cache()
        rows = events.where(F.col("source_file").endswith("a.log")).orderBy("seq").collect()
        assert [r.raw for r in rows[:-1]] == ATTACK and rows[-1].message == "\ufffd bad"
        found = auth_triage.triage_events(events, staged=False).summary.orderBy("source_file").collect()
        assert [r.total_findings for r in found] == [6, 0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents(spark, tmp_path):
    entries = [
        {"value": "A.com", "category": "domain", "confidence": "low"},
        {"value": "a.com", "category": "domain", "confidence": "high", "source": "s", "notes": "n"},
    ]
    (tmp_path / "feed.json").write_text(json.dumps({"_comment": "x", "indicators": entries}, indent=1))
    (feed,) = tables.read_feed(spark, str(tmp_path / "feed.json")).collect()
    assert (feed.value_lc, feed.confidence, feed.notes) == ("a.com", "high", "n")
    (tmp_path / "t.json").write_text(json.dumps({"techniques": [{"id": "T1", "name": "n", "tactic": "a, b", "text": "t"}]}, indent=1))
    assert tables.read_techniques(spark, str(tmp_path / "t.json")).first().id == "T1"
    (tmp_path / "words.txt").write_text("Nmap \n\n  CMD.exe\n")
    words = text.read_keywords(spark, str(tmp_path / "words.txt")).orderBy("ord").collect()
    assert [w.keyword for w in words] == ["nmap", "", "cmd.exe"]
    (tmp_path / "alert.txt").write_text("two\nlines\n")
    assert text.read_alerts(spark, str(tmp_path / "alert.txt")).first().text == "two\nlines\n"


def test_staging_keeps_rows_and_prunes_folders(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("kind"))
    back = stage(df, "t", ["kind"])
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    plan = back.where("kind = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    assert new_path(spark, "t").startswith(shared_folder(spark))


def test_staged_tables_lie_in_the_named_folder_and_can_be_released(spark):
    named = spark.sparkContext.getConf().get(FOLDER_SETTING)
    assert FOLDER_SETTING == "spark.checkpoint.dir" and shared_folder(spark) == named.rstrip("/")
    df = stage(spark.range(10), "gone")
    (file,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert file.startswith(named.replace("file:///", "file:/").rstrip("/")) or file.startswith(named)
    assert release(spark) > 0 and release(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        spark.read.parquet(file).count()


def test_lines_are_parsed_once(triage):
    """Events are staged without their texts; no line pattern is left in the plans of summary and reports."""
    for df in (triage.summary, triage.findings, auth_triage.json_report(triage, AT), auth_triage.markdown_report(triage, AT)):
        assert "[A-Za-z]{3}" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_alerts_are_read_once(spark):
    alerts = spark.createDataFrame([(1, "mail a@x.com"), (2, None)], "alert_id long, text string")
    scored = alert_triage.triage_alerts(alerts)
    assert "regexp_extract_all" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_ascii(spark, lines):
    found = auth_triage.triage_logs(lines("Jan 10 03:28:11 web crontab[9]: (j\u00fcrgen\U0001f642) REPLACE (x)"), default_year=2026)
    text_ = "\n".join(document(auth_triage.markdown_report(found, AT), "a.log"))
    assert '`{"user": "j\\u00fcrgen\\ud83d\\ude42"}`' in text_


def test_large_thresholds_are_refused(spark, lines):
    events = parse_syslog(lines(*ATTACK), default_year=2026)
    with pytest.raises(ValueError, match="windowGroupLimitThreshold"):
        brute_force_clusters(events, threshold=1001)


def test_entries_by_line_and_several_files(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text('{"pos": 2, "value": "A.com", "category": "domain", "notes": "late"}\n{"pos": 1, "value": "a.com", "category": "domain"}\n')
    (feed,) = tables.read_feed_lines(spark, str(tmp_path / "feed.jsonl")).collect()
    assert (feed.value_lc, feed.notes) == ("a.com", "late")
    for name, ids in (("b", ["T3"]), ("a", ["T1", "T2"])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"techniques": [{"id": i} for i in ids]}))
    rows = tables.read_techniques(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")]).orderBy("ord").collect()
    assert [(r.ord, r.id) for r in rows] == [(0, "T1"), (1, "T2"), (2, "T3")]
    (tmp_path / "alerts.jsonl").write_text('{"alert_id": "x", "text": "two\\nlines"}\n')
    assert text.read_alert_lines(spark, str(tmp_path / "alerts.jsonl")).first() == ("x", "two\nlines")


def test_reports_of_alerts_are_compressed(spark, tmp_path):
    """The reports lie in files of gzip and come back whole (F10)."""
    from triagemill.workload import alerts as workload

    docs = [(i, f"see hxxp://evil{i}[.]example[.]com now", "en", "web", 40) for i in range(6)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": spark.createDataFrame([(1, "http://a.com", "<p>b</p>")], "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([(0, "see evil now"), (1, "other words")], "item_id long, text string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    report = workload.alert_report_json(spark, str(tmp_path))
    assert all(name.endswith(".json.gz") for name in report.inputFiles()) and report.count() == 7
