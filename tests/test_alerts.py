import json

import pytest
from pyspark.sql import functions as F

from triagemill.operators import alerts as A
from triagemill.operators import enrich as E
from triagemill.plans import alert_triage
from triagemill.plans.staging import new_path
from triagemill.sources import bundled, sinks


@pytest.fixture
def feed(spark):
    return E.latest_entries(bundled.demo_feed(spark))


@pytest.fixture
def lookup(spark, feed):
    def run(*pairs):
        rows = [(i, c, v, v.lower()) for i, (c, v) in enumerate(pairs)]
        frame = spark.createDataFrame(rows, "alert_id long, category string, value string, value_lc string")
        return E.enrich(frame, feed).orderBy("alert_id").collect()

    return run


def test_lookup(lookup):
    hit, upper, other, public = lookup(
        ("ipv4", "185.220.101.1"), ("domain", "EVIL-C2-PANEL.com"), ("domain", "185.220.101.1"), ("ipv4", "8.8.8.8")
    )
    assert (hit.is_known_malicious, hit.confidence) == (True, "high")
    assert upper.is_known_malicious and upper.value == "EVIL-C2-PANEL.com"
    assert not other.is_known_malicious
    assert (public.notes, public.confidence) == ("No match in local threat-intel feed.", None)


@pytest.mark.parametrize(
    "address, private",
    [
        ("10.20.4.17", True), ("127.0.0.1", True), ("203.0.113.5", True), ("169.254.1.1", True), ("172.31.255.255", True),
        ("172.32.0.0", False), ("100.64.0.1", False), ("192.0.0.9", False), ("192.0.0.10", False), ("192.0.0.11", True),
        ("192.0.0.171", True), ("255.255.255.255", True), ("239.255.255.255", False), ("0.0.0.0", True), ("8.8.8.8", False),
    ],
)
def test_private_addresses(lookup, address, private):
    assert lookup(("ipv4", address))[0].notes.startswith("RFC 1918") == private


def test_last_feed_entry_wins_and_missing_notes_are_empty(spark):
    rows = [(0, "A.com", "domain", "low", "s", "old"), (1, "a.COM", "domain", "high", "s", None)]
    feed = E.latest_entries(spark.createDataFrame(rows, "pos int, value string, category string, confidence string, source string, notes string"))
    frame = spark.createDataFrame([(1, "domain", "a.com", "a.com")], "alert_id long, category string, value string, value_lc string")
    (row,) = E.enrich(frame, feed).collect()
    assert (row.confidence, row.notes) == ("high", "")


@pytest.mark.parametrize(
    "sure, hit, impact, strong, expected",
    [
        (True, True, True, False, "critical"), (True, True, False, False, "high"), (False, True, True, False, "high"),
        (False, True, False, False, "medium"), (False, False, True, True, "medium"), (False, False, True, False, "low"),
        (False, False, False, False, "low"),
    ],
)
def test_severity_ladder(spark, sure, hit, impact, strong, expected):
    column = A.severity_of(*(F.lit(x) for x in (sure, hit, impact, strong)))
    assert spark.range(1).select(column).first()[0] == expected


@pytest.mark.parametrize("score, tactic, expected", [(0.15, "Execution, Impact", "critical"), (0.1499, "Impact", "high"), (0.9, "Discovery", "high")])
def test_impact_threshold(spark, score, tactic, expected):
    enriched = spark.createDataFrame(
        [(1, "ipv4", "1.1.1.1", "1.1.1.1", True, "high", "s", "n")],
        "alert_id long, category string, value string, value_lc string, is_known_malicious boolean, confidence string, "
        "source string, notes string",
    )
    matched = spark.createDataFrame(
        [(1, 1, "T1", "name", tactic, "text", score)],
        "alert_id long, rank int, id string, name string, tactic string, technique_text string, score double",
    )
    evidence = A.alert_evidence(enriched, matched)
    assert A.score_alerts(enriched.select("alert_id"), evidence).first().severity == expected


ALERT = """  Beacon from 10.1.2.3 to 185[.]220[.]101[.]1 every five minutes; encoded PowerShell command line seen,
ransomware note dropped and data on target systems encrypted for impact. See hxxps://evil-c2-panel[.]com/x """


def test_end_to_end(spark):
    alerts = spark.createDataFrame([(1, ALERT), (2, "User logged in from the office at 10.0.0.5."), (3, "")], "alert_id long, text string")
    triaged = alert_triage.triage_alerts(alerts)
    one, two, three = triaged.orderBy("alert_id").collect()
    assert one.severity in ("critical", "high") and two.severity == three.severity == "low"
    assert [(i.category, i.value) for i in one.indicators] == [
        ("domain", "evil-c2-panel.com"), ("ipv4", "10.1.2.3"), ("ipv4", "185.220.101.1"), ("url", "https://evil-c2-panel.com/x"),
    ]
    assert "185.220.101.1 (ipv4)" in one.summary and f"Severity: {one.severity.upper()}." in one.summary
    assert "No indicators matched" in two.summary and three.indicators == [] == three.techniques

    # Texts read once or twice: the same but for the order in which scores are summed.
    scores = F.transform("techniques", lambda t: F.struct(t["id"], F.round(t["score"], 9)))
    once, twice = (
        sorted(map(repr, df.select("alert_id", "indicators", "severity", "summary", scores.alias("scores")).collect()))
        for df in (triaged, alert_triage.triage_alerts(alerts, staged=False))
    )
    assert once == twice

    triaged = alert_triage.triage_alerts(alerts, context=True)
    path = new_path(spark, "reports")
    sinks.write_json(alert_triage.alert_report(triaged, alerts), path)
    docs = {d["alert_id"]: d for d in (json.loads(r.value) for r in spark.read.text(path).collect())}
    doc = docs[1]
    private = next(e for e in doc["enrichment"] if e["value"] == "10.1.2.3")
    assert private["confidence"] is None and private["source"] is None and private["is_known_malicious"] is False
    assert [i["context"] for i in doc["indicators"] if i["value"] == "10.1.2.3"] == ["Beacon from 10.1.2.3 to 185.220.101.1 every five minutes; en"]
    assert docs[3]["indicators"] == [] and docs[3]["llm_backed"] is False
    assert doc["alert_text"] == ALERT and doc["severity"] == one.severity
    assert all(t["relevance"] == round(t["relevance"], 3) for t in doc["matched_techniques"])


def test_prompt(spark):
    alerts = spark.createDataFrame([(1, ALERT), (2, "")], "alert_id long, text string")
    prompts = {r.alert_id: r.prompt for r in alert_triage.prompt_table(alerts, top_k=1).collect()}
    lines = prompts[1].split("\n")
    assert lines[:2] == ["## Alert", ALERT.strip().split("\n")[0]]
    assert "- [ipv4] 185.220.101.1" in lines
    assert any(x.startswith("- 185.220.101.1 (ipv4) — KNOWN MALICIOUS, confidence=high, source=demo-feed: ") for x in lines)
    assert sum("[relevance=0." in x for x in lines) == 1
    assert prompts[2] == (
        "## Alert\n\n\n## Extracted indicators\n- (none found)\n\n## Threat-intel enrichment\n"
        "- No indicators matched the local threat-intel feed.\n\n## Retrieved ATT&CK context (RAG)\n"
        "- No closely matching techniques retrieved.\n\n## Heuristic severity: low"
    )
