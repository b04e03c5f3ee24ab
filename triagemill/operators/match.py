"""Processes against regex rules, and rule tables against their own requirements."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.pin import pin
from ..functions.text import UNICODE_NO_CASE
from .required import folded, required

HIT = (
    "ARRAY<STRUCT<rule_ord: INT, rule_id: STRING, severity: STRING, severity_rank: INT, mitre_tactic: STRING, "
    "mitre_technique: STRING, description: STRING, matched_field: STRING, matched_text: STRING>>"
)


@dataclass(frozen=True)
class Rule:
    """One detection rule. Rules are configuration: a short list that turns into columns of the plan."""

    id: str
    pattern: str
    match_fields: tuple[str, ...]
    severity: str
    mitre_tactic: str
    mitre_technique: str
    description: str = ""


def haystack(field: str) -> Column:
    """What a rule searches: the command line joined by single spaces, other fields as they are."""
    return F.array_join(F.col("cmdline"), " ") if field == "cmdline" else F.col(field)


def _hit(rule: Rule, ord_: int) -> Column:
    """The match of one rule in the first of its fields that matches, or null."""
    pattern = UNICODE_NO_CASE + rule.pattern
    literals = required(rule.pattern)
    result = None
    for field in rule.match_fields:
        text = F.col(f"_{field}")
        # A literal is found far sooner than a pattern that knows no case.
        held = F.lit(False)
        for literal in literals:
            held = held | F.contains(f"_{field}_folded", F.lit(literal))
        matches = (F.length(text) > 0) & (held if literals != [""] else F.lit(True)) & text.rlike(pattern)
        hit = F.struct(
            F.lit(ord_).alias("rule_ord"),
            F.lit(rule.id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"),
            F.lit(V.RULE_SEVERITY_RANK[rule.severity]).alias("severity_rank"),
            F.lit(rule.mitre_tactic).alias("mitre_tactic"),
            F.lit(rule.mitre_technique).alias("mitre_technique"),
            F.lit(rule.description).alias("description"),
            F.lit(field).alias("matched_field"),
            F.regexp_extract(text, pattern, 0).alias("matched_text"),
        )
        result = F.when(matches, hit) if result is None else result.when(matches, hit)
    return result if result is not None else F.lit(None)


def with_rule_hits(processes: DataFrame, rules: Sequence[Rule], out: str = "hits") -> DataFrame:
    """Add the hits of all rules as an array in rule order.

    Each rule becomes one expression with a literal pattern, compiled once per task: one scan, no join, no shuffle. A
    pattern is tried only on a text that holds one of the literals it cannot do without.
    """
    fields = sorted({f for r in rules for f in r.match_fields})
    searched = processes.select("*", *(haystack(f).alias(f"_{f}") for f in fields))
    for f in fields:
        searched = pin(searched, f"_{f}_folded", folded(F.col(f"_{f}")))
    hits = [_hit(r, i) for i, r in enumerate(rules) if r.match_fields]
    found = F.array_compact(F.array(*hits)) if hits else F.array()
    return pin(searched, out, found.cast(HIT)).drop(*(f"_{f}{more}" for f in fields for more in ("", "_folded")))


def findings_of(scanned: DataFrame) -> DataFrame:
    """One row per (process, rule) hit of :func:`with_rule_hits`."""
    rest = [c for c in scanned.columns if c != "hits"]
    return scanned.select(*rest, F.explode(F.filter("hits", lambda h: h["rule_ord"] >= 0)).alias("h")).select(
        *rest, "h.*"
    )


def evaluate(processes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every finding of every rule on every process."""
    return findings_of(with_rule_hits(processes, rules))


def process_counts(
    scanned: DataFrame, scope: Sequence[str] = ("host", "snapshot_ts"), min_severity: str = "low"
) -> DataFrame:
    """Processes, findings and highest severity per scope in one aggregate, straight from the hit arrays.

    ``min_severity`` narrows the number of findings; the highest severity stays that of all findings.
    """
    threshold = V.RULE_SEVERITY_RANK[min_severity]
    kept = F.size(F.filter("hits", lambda h: h["severity_rank"] >= threshold))
    worst = F.max(F.array_max("hits.severity_rank"))
    highest = F.lit(None).cast("string")
    for name, rank in V.RULE_SEVERITY_RANK.items():
        highest = F.when(worst == rank, name).otherwise(highest)
    return scanned.groupBy(*scope).agg(
        F.count("*").alias("process_count"),
        F.sum(kept).alias("finding_count"),
        highest.alias("highest_severity"),
    )


def at_least(scanned: DataFrame, min_severity: str) -> DataFrame:
    """Keep the hits of a severity or above in the hit arrays; processes stay."""
    threshold = V.RULE_SEVERITY_RANK[min_severity]
    return pin(
        scanned.withColumnRenamed("hits", "_all"), "hits", F.filter("_all", lambda h: h["severity_rank"] >= threshold)
    ).drop("_all")


def by_severity(findings: DataFrame) -> DataFrame:
    """Report order: most severe first, then snapshot order, then rule order."""
    return findings.orderBy(F.col("severity_rank").desc(), "seq", "rule_ord")


def rule_violations(rules: DataFrame) -> DataFrame:
    """Everything wrong with a table of raw rules, one row per violation ``(rule_ord, rule_id, violation)``.

    ``rules`` has ``ord`` and the rule keys as nullable columns; null means the key is missing.
    """
    missing = F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in V.RULE_REQUIRED_KEYS)))
    bad_fields = F.array_sort(
        F.array_except("match_fields", F.array(*(F.lit(f) for f in V.RULE_MATCH_FIELDS)))
    )
    severity = F.lower("severity")
    listed = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
            F.when(
                ~severity.isin(*V.RULE_SEVERITY_RANK), F.concat(F.lit("invalid severity: "), severity)
            ),
            F.when(
                F.size(bad_fields) > 0, F.concat(F.lit("invalid match_fields: "), F.array_join(bad_fields, ", "))
            ),
        )
    )
    own = rules.select(
        F.col("ord").alias("rule_ord"), F.col("id").alias("rule_id"), F.explode(listed).alias("violation")
    )
    # Only the ids that occur twice travel on, each with its first place in the table.
    repeated = (
        rules.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("rule_id"))
        .agg(F.count("*").alias("n"), F.min("ord").alias("rule_ord"))
        .where("n > 1")
        .select("rule_ord", "rule_id", F.lit("duplicate id").alias("violation"))
    )
    return own.unionByName(repeated)


def invalid_patterns(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The patterns that Java's regular expressions, which Spark uses, cannot compile. No job is run."""
    bad = []
    for pattern in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(UNICODE_NO_CASE + pattern)
        except IllegalArgumentException:
            # A PatternSyntaxException, as PySpark passes it on; anything else is not the pattern's fault.
            bad.append(pattern)
    return bad
