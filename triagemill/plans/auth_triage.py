"""From log lines to findings, summaries and reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import ascii_json, json_string, joined
from ..functions.time import iso
from ..operators import score
from ..operators.detect import ORDER_KEYS, SCOPE, all_findings
from ..operators.parse import parse_syslog, security_events, without_text
from .staging import stage

Summarizer = Callable[[DataFrame], DataFrame]


class AuthTriage:
    """Findings (one row each) and summary (one row per log file) of a run.

    Both are plans over the staged events: who reads one of them pays for nothing else. Reports, which read both more
    than once, take them from :meth:`kept`.
    """

    def __init__(self, findings: DataFrame, ranges: DataFrame, summarizer: Summarizer, staged: bool):
        self.findings = findings
        self._ranges, self._summarizer, self._staged = ranges, summarizer, staged

    @cached_property
    def summary(self) -> DataFrame:
        return self._summarizer(score.scope_summary(self._ranges, self.findings))

    @cached_property
    def _kept(self) -> AuthTriage:
        own = AuthTriage(stage(self.findings, "findings"), self._ranges, self._summarizer, False)
        own.summary = stage(own.summary, "summary")
        return own

    def kept(self) -> AuthTriage:
        """The same with findings and summary staged, once."""
        return self._kept if self._staged else self


def triage_events(
    events: DataFrame,
    window_seconds: int = V.BRUTE_FORCE_WINDOW_SECONDS,
    threshold: int = V.BRUTE_FORCE_THRESHOLD,
    summarizer: Summarizer = score.template_narrative,
    staged: bool = True,
) -> AuthTriage:
    """Run every detector over parsed events.

    By default all events are staged without their texts, so lines are parsed once. They are sorted by kind within
    their split, which costs no shuffle and lets a detector skip the pages of kinds it does not look at.
    """
    narrow = without_text(events)
    if staged:
        narrow = stage(narrow.sortWithinPartitions("kind"), "events")
    findings = all_findings(security_events(narrow), window_seconds, threshold)
    return AuthTriage(findings, score.event_ranges(narrow), summarizer, staged)


def triage_logs(
    lines: DataFrame, default_year: int | None = None, as_of: datetime | None = None, **options
) -> AuthTriage:
    """Lines ``(source_file, seq, value)`` to findings and summary. "Now" is fixed once for all parts of the run."""
    if default_year is None and as_of is None:
        as_of = datetime.now()
    return triage_events(parse_syslog(lines, default_year, as_of), **options)


def evidence_text(evidence: Column, type_: Column) -> Column:
    """Evidence as a JSON object with a space after each colon and comma."""

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), value)

    def text(name: str) -> Column:
        return member(name, ascii_json(json_string(evidence[name])))

    def number(name: str) -> Column:
        return member(name, evidence[name].cast("string"))

    users = F.concat(
        F.lit("["), F.array_join(F.transform(evidence["users_targeted"], lambda u: ascii_json(json_string(u))), ", "), F.lit("]")
    )
    bodies = {
        "brute_force": (
            text("ip"),
            number("attempt_count"),
            member("users_targeted", users),
            number("window_seconds"),
        ),
        "compromise_after_brute_force": (text("ip"), text("user"), number("prior_failed_attempts")),
        "privilege_escalation": (text("invoker"), text("command"), number("correlated_with_compromise")),
        "persistence_root_account": (text("name"), number("uid")),
        "persistence_crontab": (text("user"),),
    }
    body = F.lit(None).cast("string")
    for name, members in bodies.items():
        body = F.when(type_ == name, F.concat_ws(", ", *members)).otherwise(body)
    return F.concat(F.lit("{"), body, F.lit("}"))


LINE_KEYS = (SCOPE, "section", *ORDER_KEYS)


def _lines(rows: DataFrame, section: int, text: Column, keyed: bool = False) -> DataFrame:
    """One block of a report; blocks of a section stand in the order of ``ORDER_KEYS``."""
    keys = [F.col(k) if keyed else F.lit(None) for k in ORDER_KEYS]
    return rows.select(SCOPE, F.lit(section).alias("section"), *(k.alias(n) for k, n in zip(keys, ORDER_KEYS)), text.alias("line"))


def markdown_report(triage: AuthTriage, generated_at: datetime) -> DataFrame:
    """Report blocks ``(source_file, section, order keys, line)``; in key order their lines are the document.

    A block is at most a few lines, whatever the number of findings of a file.
    """
    triage = triage.kept()
    s, found = triage.summary, F.col("total_findings") > 0
    span = F.when(
        F.col("start").isNotNull(), F.concat(F.lit("Time range: "), iso(F.col("start")), F.lit(" to "), iso(F.col("end")))
    )
    counts = [
        F.when(F.col(n.lower()) > 0, F.concat(F.lit(f"  - {n}: "), F.col(n.lower()))) for n in V.AUTH_SEVERITY_RANK
    ]
    head = joined(
        [
            F.concat(F.lit("# Incident Triage Report: "), F.col(SCOPE)),
            F.lit(""),
            F.lit(f"Generated: {generated_at.isoformat()}"),
            F.concat(F.lit("Events analyzed: "), F.col("event_count")),
            span,
            F.lit(""),
            F.lit("## Summary"),
            F.lit(""),
            F.concat(F.lit("- Total findings: "), F.col("total_findings")),
            F.concat(F.lit("- Highest severity: "), F.coalesce("highest_severity", F.lit("None"))),
            F.concat(F.lit("- Risk score: "), F.col("risk_score"), F.lit("/100")),
            *counts,
            F.lit(""),
            F.lit("## Findings"),
            F.lit(""),
            F.when(~found, F.lit("No security-relevant patterns detected.")),
            F.when(~found, F.lit("")),
        ]
    )
    finding = joined(
        [
            F.concat(F.lit("### ["), F.col("severity"), F.lit("] "), F.col("title")),
            F.lit(""),
            F.col("description"),
            F.lit(""),
            F.concat(F.lit("- First seen: "), iso(F.col("first_seen"))),
            F.concat(F.lit("- Last seen: "), iso(F.col("last_seen"))),
            F.concat(F.lit("- Evidence: `"), evidence_text(F.col("evidence"), F.col("type")), F.lit("`")),
            F.lit(""),
        ]
    )
    narrative = joined([F.lit("## Analyst Narrative"), F.lit(""), F.col("narrative"), F.lit("")])
    told = s.where(F.coalesce(F.length("narrative"), F.lit(0)) > 0)
    return _union_by_order(
        _lines(s, 0, head), _lines(triage.findings, 1, finding, keyed=True), _lines(told, 2, narrative)
    )


def json_report(triage: AuthTriage, generated_at: datetime) -> DataFrame:
    """Report fragments in the same shape; in key order the lines of a file are one JSON document.

    Every finding but the first of a file opens with a comma; the first is known from one aggregate.
    """
    triage = triage.kept()
    order = F.struct(*ORDER_KEYS)
    first = triage.findings.groupBy(SCOPE).agg(F.min(order).alias("_first"))
    span = F.when(
        F.col("start").isNotNull(),
        F.to_json(F.struct(iso(F.col("start")).alias("start"), iso(F.col("end")).alias("end"))),
    ).otherwise("null")
    head = F.concat(
        F.lit('{"source_file":'), json_string(F.col(SCOPE)),
        F.lit(f',"generated_at":"{generated_at.isoformat()}","event_count":'), F.col("event_count"),
        F.lit(',"time_range":'), span,
        F.lit(',"findings":['),
    )
    body = F.to_json(
        F.struct(
            "type", "severity", "title", "description", "evidence",
            iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
        )
    )
    finding = F.concat(F.when(order == F.col("_first"), "").otherwise(","), body)
    summary = F.to_json(
        F.struct(
            "total_findings",
            F.struct(*(F.col(n.lower()).alias(n) for n in V.AUTH_SEVERITY_RANK)).alias("by_severity"),
            "risk_score",
            "highest_severity",
        ),
        {"ignoreNullFields": "false"},
    )
    tail = F.concat(
        F.lit('],"summary":'), summary, F.lit(',"narrative":'),
        F.coalesce(json_string(F.col("narrative")), F.lit("null")), F.lit("}"),
    )
    s = triage.summary
    return _union_by_order(
        _lines(s, 0, head), _lines(triage.findings.join(first, SCOPE), 1, finding, keyed=True), _lines(s, 2, tail)
    )


def _union_by_order(head: DataFrame, findings: DataFrame, tail: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in findings.schema.fields}
    return findings.unionByName(_typed(head, types)).unionByName(_typed(tail, types))


def _typed(rows: DataFrame, types: dict) -> DataFrame:
    return rows.withColumns({k: F.col(k).cast(types[k]) for k in ORDER_KEYS})
