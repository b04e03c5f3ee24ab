"""From alert texts to indicators, enrichment, techniques, severity and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.alerts import KEY, alert_evidence, prompt, score_alerts, triage_summary
from ..operators.enrich import enrich
from ..operators.indicators import with_indicators
from ..operators.retrieve import dealt, exploded_terms, matched_techniques, retrieval_index, top_techniques, with_terms
from ..sources import bundled
from .staging import stage


@dataclass(frozen=True)
class TextParts:
    """What is read from the texts: ``(alert_id, indicators)`` and ``(alert_id, terms)``."""

    keys: DataFrame
    indicators: DataFrame
    terms: DataFrame


def read_texts(alerts: DataFrame, context: bool = False, staged: bool = True) -> TextParts:
    """Indicators and terms of every alert. Retrieval reads the text as it came, indicators are searched in the refanged one.

    By default both are staged from one reading of the texts. Unstaged they are two branches of one plan, which each read
    the texts and write nothing; that may pay where texts are cheap to read and what is found in them is large.
    """
    own = alerts.select(KEY, "text")
    if staged:
        found = with_terms(with_indicators(own, context=context), F.col("text"))
        texts = stage(found.select(KEY, "indicators", "terms"), "texts")
        return TextParts(texts.select(KEY), texts.select(KEY, "indicators"), texts.select(KEY, "terms"))
    found = with_indicators(own, context=context).select(KEY, "indicators")
    return TextParts(alerts.select(KEY), found, with_terms(own, F.col("text")).select(KEY, "terms"))


def gather_evidence(
    texts: TextParts, corpus: DataFrame | None = None, feed: DataFrame | None = None, top_k: int = V.TOP_K
) -> DataFrame:
    """Per alert: indicators with enrichment, techniques and severity flags. Feed and corpus default to the bundled.

    ``texts`` comes from :func:`read_texts`; ``feed`` has unique keys, as the feed readers give it. The index of the
    corpus is staged: it is built once, and its real size decides whether the join with the queries is a broadcast.
    """
    spark = texts.keys.sparkSession
    corpus = corpus if corpus is not None else bundled.techniques(spark)
    if feed is None:
        feed = bundled.demo_feed(spark).select("category", F.lower("value").alias("value_lc"), "confidence", "source", "notes")
    index = stage(retrieval_index(corpus), "index")
    found = texts.indicators.select(KEY, F.explode("indicators").alias("i"))
    enriched = enrich(found.select(KEY, "i.category", "i.value", "i.value_lc", "i.context"), feed)
    counts = exploded_terms(dealt(texts.terms, texts.keys.count() * corpus.count(), index), KEY)
    ranked = top_techniques(texts.terms, corpus, top_k, index=index, counts=counts)
    return alert_evidence(enriched, matched_techniques(ranked, corpus))


def triage_alerts(
    alerts: DataFrame,
    corpus: DataFrame | None = None,
    feed: DataFrame | None = None,
    top_k: int = V.TOP_K,
    summary: Column | None = None,
    context: bool = False,
    staged: bool = True,
) -> DataFrame:
    """One row per alert: indicators, techniques, severity, summary. Texts are never shuffled.

    With ``context`` the indicators carry what stands around them, as reports want it.
    """
    texts = read_texts(alerts, context, staged)
    scored = score_alerts(texts.keys, gather_evidence(texts, corpus, feed, top_k))
    return scored.withColumn("summary", summary if summary is not None else triage_summary())


def prompt_table(
    alerts: DataFrame,
    corpus: DataFrame | None = None,
    feed: DataFrame | None = None,
    top_k: int = V.TOP_K,
    staged: bool = True,
) -> DataFrame:
    """``(alert_id, prompt)``: the one place where the text travels with its evidence."""
    evidence = gather_evidence(read_texts(alerts, staged=staged), corpus, feed, top_k)
    return score_alerts(alerts.select(KEY, "text"), evidence).select(KEY, prompt().alias("prompt"))


def alert_report(triaged: DataFrame, alerts: DataFrame) -> DataFrame:
    """One JSON-ready row per alert, scores rounded to three places; ``triaged`` carries contexts.

    Serialize it with ``ignoreNullFields=false``, as ``write_json`` does, so that every report has all its keys.
    """
    indicators = F.transform(
        "indicators", lambda i: F.struct(*(i[c].alias(c) for c in ("value", "category", "context")))
    )
    enrichment = F.transform(
        "indicators",
        lambda i: F.struct(
            *(i[c].alias(c) for c in ("value", "category", "is_known_malicious", "confidence", "source", "notes"))
        ),
    )
    techniques = F.transform(
        "techniques",
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("id", "name", "tactic")),
            t["technique_text"].alias("text"),
            F.round(t["score"], 3).alias("relevance"),
        ),
    )
    return alerts.select(KEY, F.col("text").alias("alert_text")).join(
        triaged.select(
            KEY,
            indicators.alias("indicators"),
            enrichment.alias("enrichment"),
            techniques.alias("matched_techniques"),
            "severity",
            "summary",
            F.lit(False).alias("llm_backed"),
        ),
        KEY,
    )
