"""From process snapshots to findings, new processes and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.baseline import fingerprint, new_processes, normalized
from ..operators.match import Rule, at_least, findings_of, process_counts, with_rule_hits
from ..sources.bundled import DEFAULT_RULES
from ..sources.tables import read_baseline, write_baseline
from .staging import stage

SCOPE = ("host", "snapshot_ts")


@dataclass(frozen=True)
class ProcessScan:
    """Findings, counts per snapshot and processes the baseline does not know (none without a baseline)."""

    findings: DataFrame
    counts: DataFrame
    new: DataFrame


def scan(
    processes: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    baseline: DataFrame | None = None,
    min_severity: str = "low",
    baseline_scope: Sequence[str] = (),
    staged: bool = True,
) -> ProcessScan:
    """One pass over snapshots: processes with their hits are staged, and all results come from that table."""
    clean = normalized(processes)
    scanned = with_rule_hits(clean, rules)
    if staged:
        scanned = stage(scanned, "scanned")
        clean = scanned.drop("hits")
    if baseline is not None:
        new = new_processes(clean, baseline, baseline_scope)
    else:
        new = clean.withColumn("fingerprint", fingerprint()).where(F.lit(False))
    return ProcessScan(
        findings_of(at_least(scanned, min_severity)), process_counts(scanned, SCOPE, min_severity), new
    )


def scan_with_baseline(
    spark: SparkSession,
    processes: DataFrame,
    path: str,
    update: bool = False,
    rules: Sequence[Rule] = DEFAULT_RULES,
    min_severity: str = "low",
    baseline_scope: Sequence[str] = (),
) -> ProcessScan:
    """Diff against the baseline at ``path`` if there is one, or write it anew from these processes."""
    if update:
        write_baseline(normalized(processes), path, baseline_scope)
        return scan(processes, rules, None, min_severity, baseline_scope)
    known = read_baseline(spark, path, baseline_scope) if path_exists(spark, path) else None
    return scan(processes, rules, known, min_severity, baseline_scope)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at a path of any file system Spark can read."""
    try:
        spark.read.format("text").load(path).schema
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return False
        raise
    return True


_PROCESS = "STRUCT<pid: BIGINT, name: STRING, exe: STRING, cmdline: ARRAY<STRING>, username: STRING>"
#: What a report reads back as.
DOCUMENT = (
    "host STRING, snapshot_ts STRING, scanned_at STRING, process_count BIGINT, finding_count BIGINT, "
    "highest_severity STRING, findings ARRAY<STRUCT<rule_id: STRING, severity: STRING, mitre_tactic: STRING, "
    "mitre_technique: STRING, description: STRING, matched_field: STRING, matched_text: STRING, "
    f"process: {_PROCESS}>>, new_since_baseline ARRAY<{_PROCESS}>"
)
LINE_KEYS = ("host", "snapshot_ts", "section", "place", "seq", "rule_ord")


def json_report(result: ProcessScan, scanned_at: datetime) -> DataFrame:
    """Report fragments ``(host, snapshot_ts, section, place, seq, rule_ord, line)``.

    In key order the lines of a snapshot are one JSON document: its head (section 0), its findings from the most severe
    down (1), a middle part (2), its new processes (3) and the end (4). A host with millions of findings is millions of
    lines, sorted in parallel. Each finding or process but the first of a snapshot opens with a comma; the first is
    known from one aggregate over fixed-width keys.
    """
    process = F.struct("pid", "name", "exe", "cmdline", "username")
    finding = F.struct(
        "rule_id", "severity", "mitre_tactic", "mitre_technique", "description", "matched_field", "matched_text",
        process.alias("process"),
    )
    nothing, every = F.lit(None), {"ignoreNullFields": "false"}
    counts = result.counts
    head = F.to_json(
        F.struct(
            "host",
            F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshot_ts"),
            F.lit(scanned_at.isoformat()).alias("scanned_at"),
            "process_count", "finding_count", "highest_severity",
        ),
        every,
    )

    def block(rows: DataFrame, section: int, line, place=nothing, seq=nothing, rule_ord=nothing) -> DataFrame:
        return rows.select(
            *SCOPE,
            F.lit(section).alias("section"),
            place.cast("int").alias("place"),
            seq.cast("bigint").alias("seq"),
            rule_ord.cast("int").alias("rule_ord"),
            line.alias("line"),
        )

    def separated(rows: DataFrame, order, body) -> tuple[DataFrame, Column]:
        own = rows.withColumn("_order", order.cast("decimal(38,0)"))
        first = own.groupBy(*SCOPE).agg(F.min("_order").alias("_first"))
        comma = F.when(F.col("_order") == F.col("_first"), "").otherwise(",")
        return own.join(first, [*SCOPE]), F.concat(comma, F.to_json(body, every))

    # Digits of place, row and rule one after the other; ``seq`` counts from zero.
    places = len(V.RULE_SEVERITY_RANK) - F.col("severity_rank")
    digits = (F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("seq", 19), ("rule_ord", 6)))
    by_place = F.concat(places.cast("string"), *digits)
    findings, finding_line = separated(result.findings, by_place, finding)
    new, new_line = separated(result.new, F.col("seq"), process)
    head_line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"findings":['))
    return (
        block(counts, 0, head_line)
        .unionByName(block(findings, 1, finding_line, -F.col("severity_rank"), F.col("seq"), F.col("rule_ord")))
        .unionByName(block(counts, 2, F.lit('],"new_since_baseline":[')))
        .unionByName(block(new, 3, new_line, seq=F.col("seq")))
        .unionByName(block(counts, 4, F.lit("]}")))
    )
