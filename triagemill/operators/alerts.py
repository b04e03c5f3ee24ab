"""Severity of alerts from enrichment hits and retrieved techniques, and the text that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import fill, joined, strip

KEY = "alert_id"


def _tactics(tactic: Column) -> Column:
    return F.transform(F.split(tactic, ","), strip)


def alert_evidence(enriched: DataFrame, matched: DataFrame) -> DataFrame:
    """Per alert: its indicators, hits and techniques as arrays in report order, and the flags severity hangs on.

    Both inputs go through one union and one aggregate. An array holds what one text gave rise to, no more.
    """
    impact = F.arrays_overlap(_tactics(F.col("tactic")), F.array(*(F.lit(t) for t in V.HIGH_IMPACT_TACTICS)))
    context = ["context"] if "context" in enriched.columns else []
    indicator = F.struct(
        "category", "value_lc", "value", "is_known_malicious", "confidence", "source", "notes", *context
    )
    technique = F.struct("rank", "id", "name", "tactic", "technique_text", "score")
    rows = enriched.select(
        KEY,
        indicator.alias("indicator"),
        (F.col("is_known_malicious") & (F.coalesce("confidence", F.lit("")) == "high")).alias("sure"),
        F.col("is_known_malicious").alias("hit"),
        F.lit(False).alias("impact"),
        F.lit(False).alias("strong"),
    ).unionByName(
        matched.select(
            KEY,
            technique.alias("technique"),
            F.lit(False).alias("sure"),
            F.lit(False).alias("hit"),
            ((F.col("score") >= V.HIGH_IMPACT_RELEVANCE) & impact).alias("impact"),
            (F.col("score") >= V.STRONG_RELEVANCE).alias("strong"),
        ),
        allowMissingColumns=True,
    )
    return rows.groupBy(KEY).agg(
        F.sort_array(F.collect_list("indicator")).alias("indicators"),
        F.sort_array(F.collect_list("technique")).alias("techniques"),
        *(F.bool_or(c).alias(c) for c in ("sure", "hit", "impact", "strong")),
    )


def severity_of(sure: Column, hit: Column, impact: Column, strong: Column) -> Column:
    return (
        F.when(sure & impact, "critical")
        .when(sure | (hit & impact), "high")
        .when(hit | strong, "medium")
        .otherwise("low")
    )


def score_alerts(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every alert with its evidence and severity; an alert without evidence is low."""
    flags = (F.coalesce(F.col(c), F.lit(False)) for c in ("sure", "hit", "impact", "strong"))
    scored = alerts.join(evidence, KEY, "left")
    types = {f.name: f.dataType for f in evidence.schema.fields}
    lists = (
        F.coalesce(F.col(c), F.array().cast(types[c])).alias(c) for c in ("indicators", "techniques")
    )
    return scored.select(*alerts.columns, *lists, severity_of(*flags).alias("severity"))


def _flagged() -> Column:
    return F.filter("indicators", lambda i: i["is_known_malicious"])


def triage_summary(notice: str = V.SUMMARY_NOTICE) -> Column:
    """One paragraph per alert: severity, flagged indicators, closest technique, next steps."""
    names = F.array_join(
        F.transform(_flagged(), lambda i: F.concat(i["value"], F.lit(" ("), i["category"], F.lit(")"))), ", "
    )
    top = F.get(F.col("techniques"), F.lit(0))
    return joined(
        [
            F.lit(notice),
            fill(V.SUMMARY_SEVERITY, F.upper("severity")),
            F.when(F.size(_flagged()) > 0, fill(V.SUMMARY_FLAGGED, names)).otherwise(V.SUMMARY_NONE_FLAGGED),
            F.when(F.size("techniques") > 0, fill(V.SUMMARY_TECHNIQUE, top["id"], top["name"], top["tactic"])),
            F.lit(V.SUMMARY_NEXT_STEPS),
        ],
        " ",
    )


def _or_none(col: Column) -> Column:
    return F.coalesce(col, F.lit("None"))


def prompt(text: str = "text") -> Column:
    """The alert and its evidence as one prompt, ready for batch inference elsewhere."""
    listed = F.transform("indicators", lambda i: F.concat(F.lit("- ["), i["category"], F.lit("] "), i["value"]))
    hits = F.transform(
        _flagged(),
        lambda i: fill(
            V.PROMPT_HIT, i["value"], i["category"], _or_none(i["confidence"]), _or_none(i["source"]), i["notes"]
        ),
    )
    techniques = F.transform(
        "techniques",
        lambda t: fill(
            V.PROMPT_TECHNIQUE,
            t["id"],
            t["name"],
            t["tactic"],
            F.format_string("%.2f", t["score"]),
            t["technique_text"],
        ),
    )

    def section(items: Column, otherwise: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(otherwise)

    return joined(
        [
            F.lit(V.PROMPT_ALERT),
            strip(F.coalesce(F.col(text), F.lit(""))),
            F.lit(""),
            F.lit(V.PROMPT_INDICATORS),
            section(listed, V.PROMPT_NO_INDICATORS),
            F.lit(""),
            F.lit(V.PROMPT_ENRICHMENT),
            section(hits, V.PROMPT_NO_HITS),
            F.lit(""),
            F.lit(V.PROMPT_TECHNIQUES),
            section(techniques, V.PROMPT_NO_TECHNIQUES),
            F.lit(""),
            F.concat(F.lit(V.PROMPT_SEVERITY), F.col("severity")),
        ]
    )
