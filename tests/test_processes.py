import json
from datetime import datetime

import pytest

from triagemill.operators import baseline, match
from triagemill.operators.keywords import keyword_sweep, load_keywords
from triagemill.operators.match import Rule
from triagemill.plans import process_hunt
from triagemill.plans.staging import new_path
from triagemill.sources import bundled, tables
from triagemill.streaming import watch

NOON = datetime(2026, 3, 8, 2, 30)


@pytest.fixture
def snapshot(spark):
    def make(*rows, host="h1"):
        full = [
            (host, NOON, i, i, name, exe, cmdline.split(" ") if cmdline is not None else None, "u", 1.0)
            for i, (name, exe, cmdline) in enumerate(rows)
        ]
        return spark.createDataFrame(full, tables.PROCESS_SCHEMA)

    return make


ROWS = (("bash", "/bin/bash", "bash"), ("Mimikatz.exe", "/tmp/m", "x"), ("powershell.exe", None, "powershell -nop -enc AAA"), (None, None, None))


def rule(pattern, *fields, **options):
    return Rule(options.pop("id", "r"), pattern, fields, options.pop("severity", "low"), "t", "T1", "d")


def test_blanks(snapshot):
    row = baseline.normalized(snapshot(*ROWS)).where("seq = 3").first()
    assert (row["name"], row.exe, row.cmdline) == ("", "", [])


def test_default_rules(snapshot):
    found = match.evaluate(baseline.normalized(snapshot(*ROWS)), bundled.DEFAULT_RULES).orderBy("seq").collect()
    assert [(f.seq, f.rule_id, f.matched_field, f.matched_text) for f in found] == [
        (1, "credential-dumping-mimikatz", "name", "Mimikatz"),
        (2, "suspicious-powershell-encoded", "cmdline", "powershell -nop -enc"),
    ]
    assert len(bundled.DEFAULT_RULES) == 18


@pytest.mark.parametrize(
    "pattern, fields, row, expected",
    [
        ("x", ("exe", "name"), ("x", "y", "x"), ("name", "x")),
        ("z*", ("name",), ("abc", "", ""), ("name", "")),
        ("z*", ("exe",), ("abc", "", "q"), None),
        ("a b$", ("cmdline",), ("n", "e", "x a b"), ("cmdline", "a b")),
        ("schtasks", ("name",), ("ſchtasks", "e", ""), ("name", "ſchtasks")),
        ("a.b", ("name",), ("a\rb", "e", ""), ("name", "a\rb")),
        ("a.b", ("name",), ("a\nb", "e", ""), None),
        (r"\bé", ("name",), ("xé é", "e", ""), ("name", "é")),
    ],
)
def test_match_semantics(snapshot, pattern, fields, row, expected):
    found = match.evaluate(snapshot(row), [rule(pattern, *fields)]).collect()
    assert [(f.matched_field, f.matched_text) for f in found] == ([expected] if expected else [])


@pytest.mark.parametrize("pattern, name, hit", [(r"(a)b\1", "xaba", True), (r"(a)b\1", "xabc", False), (r"(?-i)Q", "q", False), (r"^b$|c", "bc", True)])
def test_group_references_and_inline_flags_stay_within_a_rule(snapshot, pattern, name, hit):
    rules = [rule("(zzz)", "name", id="other"), rule(pattern, "name")]
    assert [f.rule_id for f in match.evaluate(snapshot((name, "", "")), rules).collect()] == (["r"] if hit else [])


def test_no_rules(snapshot):
    assert match.evaluate(snapshot(*ROWS), []).count() == 0


def test_counts_filter_and_order(snapshot):
    rules = [rule("bash", "name", id="a"), rule("m", "name", id="b", severity="critical")]
    scanned = match.with_rule_hits(baseline.normalized(snapshot(*ROWS)), rules)
    assert [f.rule_id for f in match.by_severity(match.findings_of(scanned)).collect()] == ["b", "a"]
    low, top = (match.process_counts(scanned, min_severity=s).first() for s in ("low", "critical"))
    assert (low.process_count, low.finding_count, low.highest_severity) == (4, 2, "critical")
    assert (top.process_count, top.finding_count) == (4, 1)
    only_low = match.with_rule_hits(snapshot(*ROWS), rules[:1])
    filtered = match.process_counts(only_low, min_severity="high").first()
    assert (filtered.finding_count, filtered.highest_severity) == (0, "low")
    assert match.findings_of(match.at_least(scanned, "high")).count() == 1


def raw_rules(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "ord int, id string, pattern string, match_fields array<string>, severity string, mitre_tactic string, "
        "mitre_technique string, description string",
    )


GOOD = ("ok", "x", ["name"], "HIGH", "t", "T1", None)


@pytest.mark.parametrize(
    "row, message",
    [
        (("a", None, ["name"], "low", "t", "T1", None), "missing keys: pattern"),
        (("a", "x", ["name"], "urgent", "t", "T1", None), "invalid severity: urgent"),
        (("a", "x", ["name", "pid"], "low", "t", "T1", None), "invalid match_fields: pid"),
        (("a", "(", ["name"], "low", "t", "T1", None), "invalid regex"),
        (GOOD, "duplicate id"),
    ],
)
def test_rejected_rules(spark, row, message):
    with pytest.raises(tables.InvalidRules, match=message):
        tables.load_rules(raw_rules(spark, GOOD, row))


def test_loaded_rules(spark):
    (r,) = tables.load_rules(raw_rules(spark, GOOD))
    assert (r.severity, r.match_fields, r.description) == ("high", ("name",), "")


def test_baseline_keeps_repeats_and_ignores_pids(spark, snapshot):
    known = baseline.fingerprints(snapshot(("sshd", "/s", "a"), ("sshd", "/s", "b")))
    assert known.count() == 1
    new = baseline.new_processes(snapshot(("x", "/x", ""), ("sshd", "/s", "c"), ("x", "/x", "")), known)
    assert [r.fingerprint for r in new.collect()] == ["x:/x", "x:/x"]


def test_scan_with_baseline(spark, snapshot):
    path = new_path(spark, "baseline")
    before, after = snapshot(ROWS[0]), snapshot(*ROWS[:2])
    assert process_hunt.scan_with_baseline(spark, after, path).new.count() == 0
    assert process_hunt.scan_with_baseline(spark, before, path, update=True).new.count() == 0
    result = process_hunt.scan_with_baseline(spark, after, path)
    assert [r.name for r in result.new.collect()] == ["Mimikatz.exe"]
    lines = process_hunt.json_report(result, NOON).orderBy(*process_hunt.LINE_KEYS).collect()
    doc = json.loads("\n".join(r.line for r in lines))
    assert (doc["scanned_at"], doc["process_count"], doc["finding_count"]) == (NOON.isoformat(), 2, 1)
    assert doc["highest_severity"] == "critical" and doc["host"] == after.first().host
    (finding,), (new,) = doc["findings"], doc["new_since_baseline"]
    assert finding["rule_id"] == "credential-dumping-mimikatz" and finding["process"]["cmdline"] == ["x"]
    assert new["name"] == "Mimikatz.exe"


def test_invalid_patterns_need_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    assert match.invalid_patterns(spark, ["a(", "b", "[z", r"\p{Nosuch}", "(?<n>x)"]) == ["a(", "[z", r"\p{Nosuch}"]
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_rules_run_once_for_all_results(spark, snapshot):
    """The hits are staged; no pattern is left in the plans of findings, counts and report."""
    result = process_hunt.scan(snapshot(*ROWS), baseline=baseline.fingerprints(snapshot(ROWS[0])))
    for df in (result.findings, result.counts, result.new, process_hunt.json_report(result, NOON)):
        assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_too_many_rules_or_keywords(spark):
    with pytest.raises(tables.InvalidRules, match="more than 1"):
        tables.load_rules(raw_rules(spark, GOOD, ("b", *GOOD[1:])), most=1)
    listed = spark.createDataFrame([(1, "a"), (0, "b"), (2, None)], "ord int, keyword string")
    assert load_keywords(listed) == ["b", "a"]
    with pytest.raises(ValueError, match="more than 1"):
        load_keywords(listed, most=1)


def test_keyword_sweep(spark):
    docs = spark.createDataFrame([(1, "C:\\CMD.EXE /c"), (2, "nothing"), (3, None)], "id long, text string")
    found = keyword_sweep(docs, ["nmap", "cmd.exe", ""], "id").orderBy("id", "ord").collect()
    assert [(r.id, r.keyword) for r in found] == [(1, "cmd.exe"), (1, ""), (2, ""), (3, "")]
    assert len(bundled.KEYWORDS) == 51


def test_watch(spark, snapshot):
    source, found, new = (new_path(spark, n) for n in ("in", "found", "new"))
    for host in ("h1", "h2"):
        snapshot(*ROWS, host=host).coalesce(1).write.mode("append").parquet(source)
    known = baseline.fingerprints(snapshot(ROWS[0]))
    stream = watch.snapshot_stream(spark, source, files_per_batch=1)
    jobs = [
        watch.start(watch.watch_findings(stream), found, new_path(spark, "c1")),
        watch.start(watch.watch_new(stream, known), new, new_path(spark, "c2")),
    ]
    for job in jobs:
        job.awaitTermination()
    assert spark.read.parquet(found).count() == 4
    assert spark.read.parquet(new).count() == 6
