"""Roll-ups of authentication findings: severity counts, risk score, time range, counts per type, narrative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.severity import lookup
from ..functions.text import fill, joined
from .detect import SCOPE


def event_ranges(events: DataFrame) -> DataFrame:
    """Number of events and their first and last time, per scope."""
    return events.groupBy(SCOPE).agg(
        F.count("*").alias("event_count"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )


def _finding_counts(findings: DataFrame) -> DataFrame:
    severity = F.col("severity")
    counts = [F.count_if(severity == name).alias(name.lower()) for name in V.AUTH_SEVERITY_RANK]
    per_type = [
        F.count_if(F.col("type") == t).alias(f"n_{t}")
        for t in (
            "brute_force",
            "compromise_after_brute_force",
            "privilege_escalation",
            "persistence_root_account",
            "persistence_crontab",
        )
    ]
    return findings.groupBy(SCOPE).agg(
        F.count("*").alias("total_findings"),
        *counts,
        F.sum(lookup(severity, V.AUTH_SEVERITY_WEIGHT)).alias("weight"),
        F.max("severity_rank").alias("highest_rank"),
        *per_type,
    )


def scope_summary(scopes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per scope of ``scopes`` with all counts filled; a scope without findings scores 0 and has no highest.

    ``scopes`` holds one row per scope, such as :func:`event_ranges`, and keeps its columns.
    """
    counts = _finding_counts(findings)
    filled = [
        F.coalesce(F.col(c), F.lit(0)).alias(c)
        for c in counts.columns
        if c not in (SCOPE, "weight", "highest_rank")
    ]
    risk = F.least(F.lit(V.RISK_SCORE_CAP), F.coalesce(F.col("weight"), F.lit(0))).cast("int")
    highest = lookup(F.col("highest_rank"), {rank: name for name, rank in V.AUTH_SEVERITY_RANK.items()})
    return scopes.join(counts, SCOPE, "left").select(
        *scopes.columns, *filled, risk.alias("risk_score"), highest.alias("highest_severity")
    )


def severity_histogram(scopes: DataFrame, findings: DataFrame) -> DataFrame:
    return scope_summary(scopes, findings).select(SCOPE, *(n.lower() for n in V.AUTH_SEVERITY_RANK))


def findings_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy(SCOPE, "type").agg(F.count("*").alias("findings"))


def template_narrative(summary: DataFrame) -> DataFrame:
    """Add ``narrative`` to the rows of :func:`scope_summary`; any function of this shape can take its place."""

    def has(*types: str):
        condition = F.lit(False)
        for t in types:
            condition = condition | (F.col(f"n_{t}") > 0)
        return condition

    attack = F.when(
        has("compromise_after_brute_force", "brute_force"),
        F.concat(
            F.lit(V.NARRATIVE_BRUTE_FORCE),
            F.when(has("compromise_after_brute_force"), V.NARRATIVE_SUCCEEDED).otherwise(V.NARRATIVE_NOT_CONFIRMED),
        ),
    )
    text = joined(
        [
            fill(V.NARRATIVE_OPENING, F.col("total_findings"), F.col("highest_severity"), F.col("risk_score")),
            F.lit(""),
            attack,
            F.when(has("privilege_escalation"), fill(V.NARRATIVE_ESCALATION, F.col("n_privilege_escalation"))),
            F.when(has("persistence_root_account", "persistence_crontab"), F.lit(V.NARRATIVE_PERSISTENCE)),
            F.lit(""),
            F.lit(V.NARRATIVE_ADVICE),
        ]
    )
    return summary.withColumn("narrative", F.when(F.col("total_findings") > 0, text).otherwise(V.NARRATIVE_EMPTY))
