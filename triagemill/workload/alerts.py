"""Queries over alert texts: indicators, enrichment, retrieval, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import enrich as enrich_ops
from ..operators import indicators as ind
from ..operators import networks as networks_ops
from ..operators import retrieve
from ..operators.keywords import keyword_sweep, load_keywords, sweep_table
from ..plans import alert_triage
from ..plans.staging import new_path, stage
from ..sources import bundled, sinks
from ..sources import tables as readers
from ..sources import text as text_sources
from .tables import ALERTS_SQL, CORPUS_SQL, FEED_SQL, alerts, corpus, feed_entries, table


def alert_scan(spark, sf_dir):
    """Every alert as a text table, a row per alert, read back with its key."""
    path = new_path(spark, "alerts")
    alerts(spark, sf_dir).write.json(path)
    read = text_sources.read_alert_lines(spark, path)
    return read.select(
        F.col("alert_id").cast("bigint").alias("alert_id"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")
    )


def refang(spark, sf_dir):
    text = ind.refang(F.col("text"))
    return alerts(spark, sf_dir).select("alert_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


def _category(name):
    def query(spark, sf_dir):
        return ind.extract_indicators(alerts(spark, sf_dir), categories=[name], context=False).select(
            "alert_id", "value", "value_lc"
        )

    return query


def ioc_first_occurrence(spark, sf_dir):
    return ind.extract_indicators(alerts(spark, sf_dir), context=False)


def ioc_context(spark, sf_dir):
    return ind.extract_indicators(alerts(spark, sf_dir)).select("alert_id", "category", "value_lc", "context")


def ioc_sorted(spark, sf_dir):
    rows = ind.with_indicators(alerts(spark, sf_dir), context=False)
    listed = F.transform("indicators", lambda i: F.concat(i["category"], F.lit("="), i["value_lc"]))
    return rows.select("alert_id", F.array_join(listed, "|").alias("listed"))


def _feed(spark, sf_dir):
    return enrich_ops.latest_entries(feed_entries(spark, sf_dir))


def intel_feed_last_wins(spark, sf_dir):
    """The feed as a file with an entry per line, read back."""
    path = new_path(spark, "feed")
    feed_entries(spark, sf_dir, every=True).write.json(path)
    return readers.read_feed_lines(spark, path)


def _enriched(spark, sf_dir):
    found = ind.extract_indicators(alerts(spark, sf_dir), context=False)
    return enrich_ops.enrich(found, _feed(spark, sf_dir))


def intel_enrich(spark, sf_dir):
    return _enriched(spark, sf_dir).drop("value_lc")


def intel_enrich_large_feed(spark, sf_dir):
    """The same with the feed behind a Bloom filter of its keys."""
    found = ind.extract_indicators(alerts(spark, sf_dir), context=False)
    return enrich_ops.enrich_from_large_feed(found, _feed(spark, sf_dir)).drop("value_lc")


def network_match(spark, sf_dir):
    """The most specific of a network per order for an address per event."""
    n, k = F.col("event_id"), F.col("o_orderkey")

    def address(number):
        return F.concat_ws(".", *(F.floor(number / 256**i) % 256 for i in (3, 2, 1, 0)))

    bits = k % 27 + 6
    base = (k * 2654435761 + F.col("o_custkey") * 40503) % 4294967296
    network = F.concat(address(base - base % F.expr("shiftleft(1L, cast(32 - (o_orderkey % 27 + 6) as int))")), F.lit("/"), bits)
    networks = table(spark, sf_dir, "orders").select(network.alias("network"), k.alias("owner"))
    # Every second address lies near one of the networks of its number.
    far = (n * 2246822519 + F.col("user_id")) % 4294967296
    near = (n * 2654435761 + F.col("user_id") * 40503) % 4294967296
    events = table(spark, sf_dir, "events").select("event_id", address(F.when(n % 2 == 0, near).otherwise(far)).alias("address"))
    return networks_ops.most_specific(events, networks)


def known_malicious(spark, sf_dir):
    hits = enrich_ops.known_malicious(_enriched(spark, sf_dir))
    return hits.groupBy("category", "value_lc").agg(F.count("*").alias("alerts"))


def private_ip_note(spark, sf_dir):
    """Every address four counters of an event spell, over the whole table."""
    n, u = F.col("event_id"), F.col("user_id")
    first = F.element_at(
        F.array(*(F.lit(o) for o in (10, 100, 127, 169, 172, 192, 198, 203, 240, 255, 8, 0))), (n % 12 + 1).cast("int")
    )
    second = F.element_at(F.array(*(F.lit(o) for o in (0, 16, 18, 51, 64, 168, 254))), (u % 7 + 1).cast("int"))
    third = F.element_at(F.array(*(F.lit(o) for o in (0, 2, 100, 113))), (n % 4 + 1).cast("int"))
    address = F.concat_ws(".", first, second, third, n % 256)
    rows = table(spark, sf_dir, "events").select("event_id", address.alias("address"))
    return rows.withColumn("private", enrich_ops.is_private_address(F.col("address")))


def tokens(spark, sf_dir):
    listed = F.array_join(retrieve.tokens(F.col("text")), " ")
    return alerts(spark, sf_dir).select("alert_id", F.md5(listed).alias("digest"), F.length(listed).cast("bigint").alias("n_chars"))


def term_counts(spark, sf_dir):
    counts = retrieve.term_counts(table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text"), "turn_id", F.col("text"))
    return counts.select("turn_id", "term", F.col("n").cast("bigint").alias("n"), F.col("max_n").cast("bigint").alias("max_n"))


def technique_corpus(spark, sf_dir):
    """The corpus as a file with a technique per line, read back."""
    path = new_path(spark, "techniques")
    corpus(spark, sf_dir).write.json(path)
    return readers.read_technique_lines(spark, path).select(F.col("ord").cast("bigint").alias("ord"), "id", "name", "tactic", "text")


def doc_frequency(spark, sf_dir):
    return retrieve.document_frequency(retrieve.corpus_counts(corpus(spark, sf_dir))).select("term", "df")


def smoothed_idf(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    idf = retrieve.smoothed_idf(retrieve.document_frequency(retrieve.corpus_counts(docs)), docs)
    return idf.select("term", F.round("idf", 6).alias("idf"))


def augmented_tf(spark, sf_dir):
    return retrieve.corpus_counts(corpus(spark, sf_dir)).select(
        F.col("ord").cast("bigint").alias("ord"), "term", F.round(retrieve.augmented_tf(), 6).alias("tf")
    )


def tfidf_vectors(spark, sf_dir):
    return retrieve.corpus_vectors(corpus(spark, sf_dir)).select(
        F.col("ord").cast("bigint").alias("ord"), "term", F.round("weight", 6).alias("weight")
    )


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("alert_id"), "text")


def query_vectors(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    idf = retrieve.smoothed_idf(retrieve.document_frequency(retrieve.corpus_counts(docs)), docs)
    vectors = retrieve.query_vectors(_turns(spark, sf_dir), idf)
    return vectors.select("alert_id", "term", F.round("weight", 6).alias("weight"))


def _top(spark, sf_dir, **options):
    docs = corpus(spark, sf_dir)
    index = stage(retrieve.retrieval_index(docs), "index")
    return retrieve.top_techniques(alerts(spark, sf_dir), docs, index=index, **options)


def cosine_scores(spark, sf_dir):
    """The ten best scores of each conversation turn against the corpus."""
    docs = corpus(spark, sf_dir)
    index = stage(retrieve.retrieval_index(docs), "index")
    best = retrieve.top_techniques(_turns(spark, sf_dir), docs, top_k=10, index=index)
    return best.select("alert_id", F.col("ord").cast("bigint").alias("ord"), F.round("score", 6).alias("score"))


def tfidf_topk(spark, sf_dir):
    return _top(spark, sf_dir).select(
        "alert_id", F.col("ord").cast("bigint").alias("ord"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


def tfidf_min_score(spark, sf_dir):
    return _top(spark, sf_dir, top_k=2, min_score=0.2).select(
        "alert_id", F.col("ord").cast("bigint").alias("ord"), F.col("rank").cast("bigint").alias("rank")
    )


def relevance_rounded(spark, sf_dir):
    matched = retrieve.matched_techniques(_top(spark, sf_dir), corpus(spark, sf_dir))
    return matched.select("alert_id", "id", "name", "tactic", F.round("score", 3).alias("relevance"))


def _scored(spark, sf_dir):
    return alert_triage.triage_alerts(alerts(spark, sf_dir), corpus(spark, sf_dir), _feed(spark, sf_dir))


def alert_severity(spark, sf_dir):
    return _scored(spark, sf_dir).select("alert_id", "severity")


def triage_summary(spark, sf_dir):
    return _scored(spark, sf_dir).select("alert_id", "summary")


def alert_triage_report(spark, sf_dir):
    """End to end with everything an alert gave rise to, lists joined to text."""
    rows = _scored(spark, sf_dir)
    hits = F.filter("indicators", lambda i: i["is_known_malicious"])
    return rows.select(
        "alert_id",
        "severity",
        F.size("indicators").cast("bigint").alias("n_indicators"),
        F.array_join(F.transform(hits, lambda i: i["value"]), ",").alias("hits"),
        F.array_join(F.transform("techniques", lambda t: t["id"]), ",").alias("techniques"),
    )


def bundled_alert_triage(spark, sf_dir):
    """End to end with the bundled feed and techniques."""
    rows = alert_triage.triage_alerts(alerts(spark, sf_dir))
    return rows.select("alert_id", "severity", F.array_join("techniques.id", ",").alias("techniques"))


def prompt_table(spark, sf_dir):
    prompts = alert_triage.prompt_table(alerts(spark, sf_dir), corpus(spark, sf_dir), _feed(spark, sf_dir))
    return prompts.select("alert_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest"))


def alert_report_json(spark, sf_dir):
    """The JSON report of each alert, written in compressed files and read back as text."""
    texts = alerts(spark, sf_dir)
    triaged = alert_triage.triage_alerts(texts, corpus(spark, sf_dir), _feed(spark, sf_dir), context=True)
    path = new_path(spark, "reports")
    sinks.write_json(alert_triage.alert_report(triaged, texts), path, compression="gzip")
    report = F.regexp_extract("value", r'^\{"alert_id":(\d+),(.*)$', 2)
    key = F.regexp_extract("value", r'^\{"alert_id":(\d+),', 1).cast("bigint")
    return spark.read.text(path).select(key.alias("alert_id"), F.concat(F.lit("{"), report).alias("report"))


_SWEEP = (*bundled.KEYWORDS, "tion", "example.com", "the", "")


def keyword_list(spark, sf_dir):
    """Every line of every document as an entry of a keyword list, written and read back."""
    path = new_path(spark, "keywords")
    table(spark, sf_dir, "documents").select(F.concat(F.lit(" \t"), "text", F.lit(" "))).write.text(path)
    return text_sources.read_keywords(spark, path).groupBy("keyword").agg(F.count("*").alias("n"))


def keyword_hits(spark, sf_dir):
    """The sweep with a list that is kept in a file."""
    path = new_path(spark, "sweep")
    spark.createDataFrame([(k,) for k in _SWEEP], "value string").coalesce(1).write.text(path)
    listed = load_keywords(text_sources.read_keywords(spark, path))
    return keyword_sweep(alerts(spark, sf_dir), listed, "alert_id").select(
        "alert_id", F.col("ord").cast("bigint").alias("ord"), "keyword"
    )


def keyword_table(spark, sf_dir):
    """Thousands of keywords, the insides of all long words, kept as a table and searched in every document."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    inside = F.expr("substring(w, 3, least(length(w) - 8, 7))")
    listed = words.where("length(w) >= 11").select(inside.alias("keyword")).distinct()
    return sweep_table(docs, listed.withColumn("ord", F.col("keyword")), "doc_id").select("doc_id", "keyword")


QUERIES = {
    "alert_scan": alert_scan,
    "refang": refang,
    **{f"ioc_{c}": _category(c) for c in V.CATEGORIES},
    "ioc_first_occurrence": ioc_first_occurrence,
    "ioc_context": ioc_context,
    "ioc_sorted": ioc_sorted,
    "intel_feed_last_wins": intel_feed_last_wins,
    "intel_enrich": intel_enrich,
    "intel_enrich_large_feed": intel_enrich_large_feed,
    "network_match": network_match,
    "known_malicious": known_malicious,
    "private_ip_note": private_ip_note,
    "technique_corpus": technique_corpus,
    "tokens": tokens,
    "term_counts": term_counts,
    "doc_frequency": doc_frequency,
    "smoothed_idf": smoothed_idf,
    "augmented_tf": augmented_tf,
    "tfidf_vectors": tfidf_vectors,
    "query_vectors": query_vectors,
    "cosine_scores": cosine_scores,
    "tfidf_topk": tfidf_topk,
    "tfidf_min_score": tfidf_min_score,
    "relevance_rounded": relevance_rounded,
    "alert_severity": alert_severity,
    "triage_summary": triage_summary,
    "alert_triage": alert_triage_report,
    "bundled_alert_triage": bundled_alert_triage,
    "prompt_table": prompt_table,
    "alert_report_json": alert_report_json,
    "keyword_list": keyword_list,
    "keyword_sweep": keyword_hits,
    "keyword_table": keyword_table,
}

REFANGED_SQL = f"""{ALERTS_SQL},
refanged AS (
  SELECT alert_id, text AS raw, replace(replace(replace(replace(replace(replace(replace(text, 'hxxps://', 'https://'),
    'hxxp://', 'http://'), '[.]', '.'), '(.)', '.'), '[:]', ':'), '[at]', '@'), '[@]', '@') AS text
  FROM alerts)"""

# The pattern of each category.
_PATTERNS = {
    "url": """(?i)\\bhttps?://[^\\s"''<>)]+""",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "cve": r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24}\b",
}
_TLDS = ", ".join(f"'{t}'" for t in V.TOP_LEVEL_DOMAINS)


def _found_sql(names) -> str:
    """Matches with their place: texts are cut at the matches, and the lengths of the cuts add up to the places.

    \\b is ASCII here, so letters beyond ASCII count as word characters by standing in as underscores.
    """
    cuts = "\n  UNION ALL ".join(
        f"""SELECT alert_id, text, '{n}' AS category,
    string_split(regexp_replace(plain, '({_PATTERNS[n]})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces
    FROM plain"""
        for n in names
    )
    return f"""{REFANGED_SQL},
plain AS (
  SELECT alert_id, text, regexp_replace(text, '[^\\x00-\\x7F\\P{{L}}]', '_', 'g') AS plain FROM refanged),
cuts AS (
  {cuts}),
pieces AS (
  SELECT alert_id, text, category, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n FROM cuts),
placed AS (
  SELECT *, sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY alert_id, category ORDER BY n) AS past
  FROM pieces),
matches AS (
  SELECT alert_id, category, text, past - length(replace(piece, chr(2), '')) AS pos, strpos(piece, chr(2)) - 1 AS len
  FROM placed WHERE n > 1),
valued AS (
  SELECT *, substring(text, CAST(pos + 1 AS BIGINT), CAST(len AS BIGINT)) AS value FROM matches),
kept AS (
  SELECT *, lower(value) AS value_lc FROM valued
  WHERE CASE category WHEN 'ipv4' THEN NOT regexp_matches(value, '\\b0\\d')
    WHEN 'domain' THEN lower(value) NOT IN ('e.g.com', 'i.e.com') AND lower(split_part(value, '.', -1)) IN ({_TLDS})
    ELSE true END),
indicators AS (
  SELECT alert_id, category, value, value_lc,
    trim(regexp_replace(replace(substring(text, CAST(greatest(pos - 40, 0) + 1 AS BIGINT),
      CAST(pos + len + 40 - greatest(pos - 40, 0) AS BIGINT)), chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS context
  FROM kept
  QUALIFY row_number() OVER (PARTITION BY alert_id, category, value_lc ORDER BY pos) = 1)"""


INDICATORS_SQL = _found_sql(_PATTERNS)


def _range_test(column: str) -> str:
    def within(networks):
        tests = []
        for network in networks:
            base, bits = network.split("/")
            number = sum(int(o) * 256 ** (3 - i) for i, o in enumerate(base.split(".")))
            tests.append(f"{column} BETWEEN {number} AND {number + 2 ** (32 - int(bits)) - 1}")
        return "(" + " OR ".join(tests) + ")"

    return f"({within(V.PRIVATE_NETWORKS)} AND NOT {within(V.PUBLIC_EXCEPTIONS)})"


def _number_sql(column: str) -> str:
    parts = [f"CAST(split_part({column}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"((({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]})"


ENRICHED_SQL = f"""{INDICATORS_SQL},{FEED_SQL},
numbered AS (
  SELECT *, CASE WHEN category = 'ipv4' THEN {_number_sql('value')} END AS number FROM indicators),
enriched AS (
  SELECT n.*, f.category IS NOT NULL AS is_known_malicious, f.confidence, f.source,
    CASE WHEN f.category IS NOT NULL THEN coalesce(f.notes, '')
      WHEN n.category = 'ipv4' AND {_range_test('number')} THEN '{V.NOTE_PRIVATE}'
      ELSE '{V.NOTE_NO_MATCH}' END AS notes
  FROM numbered n LEFT JOIN feed f ON f.category = n.category AND f.value_lc = n.value_lc)"""

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


def _tokens_sql(text: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all({text}, '{V.TOKEN_PATTERN}'), lambda w: lower(w)),
      lambda w: w NOT IN ({_STOP}))"""


def _tf_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_tokens AS (SELECT {key}, unnest({_tokens_sql(text)}) AS term FROM {source}),
{name}_counts AS (SELECT {key}, term, count(*) AS n FROM {name}_tokens GROUP BY 1, 2),
{name}_tf AS (
  SELECT *, max(n) OVER (PARTITION BY {key}) AS max_n, 0.5::DOUBLE + 0.5::DOUBLE * n / max(n) OVER (PARTITION BY {key}) AS tf
  FROM {name}_counts)"""


INDEX_SQL = f"""{CORPUS_SQL},{_tf_sql('corpus', 'corpus', 'ord', "name || ' ' || text")},
frequency AS (SELECT term, count(*) AS df FROM corpus_counts GROUP BY 1),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1 + df)) + 1.0 AS idf FROM frequency),
corpus_w AS (SELECT ord, term, idf, tf * idf AS w FROM corpus_tf JOIN idf USING (term)),
vectors AS (SELECT ord, term, idf, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS weight FROM corpus_w)"""


def _query_sql(source: str) -> str:
    return f"""{INDEX_SQL},{_tf_sql('query', source, 'alert_id', 'text')},
query_w AS (SELECT alert_id, term, tf * idf AS w FROM query_tf JOIN idf USING (term)),
query_vectors AS (SELECT alert_id, term, w, w / sqrt(sum(w * w) OVER (PARTITION BY alert_id)) AS weight FROM query_w),
scores AS (
  SELECT alert_id, ord, sum(q.weight * v.weight) AS score, sum(q.w * v.weight) AS dot
  FROM query_vectors q JOIN vectors v USING (term) GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY round(dot, 9) DESC, ord) AS rank
  FROM scores WHERE score > 0)"""


TURNS_SQL = "turns AS (SELECT conv_id || '-' || turn AS alert_id, text FROM conversations)"
TRIAGE_SQL = f"""{ENRICHED_SQL},{_query_sql('alerts')},
techniques AS (
  SELECT r.alert_id, r.rank, r.score, c.id, c.name, c.tactic, c.text AS technique_text
  FROM ranked r JOIN corpus c USING (ord) WHERE r.rank <= 3),
by_hit AS (
  SELECT alert_id, count(*) AS n_indicators, bool_or(is_known_malicious) AS hit,
    bool_or(is_known_malicious AND coalesce(confidence, '') = 'high') AS sure,
    string_agg('- [' || category || '] ' || value, chr(10) ORDER BY category, value_lc) AS listed,
    string_agg(value, ',' ORDER BY category, value_lc) FILTER (is_known_malicious) AS hits,
    string_agg(value || ' (' || category || ')', ', ' ORDER BY category, value_lc) FILTER (is_known_malicious) AS named,
    string_agg('- ' || value || ' (' || category || ') — KNOWN MALICIOUS, confidence=' || coalesce(confidence, 'None')
      || ', source=' || coalesce(source, 'None') || ': ' || notes, chr(10) ORDER BY category, value_lc)
      FILTER (is_known_malicious) AS explained
  FROM enriched GROUP BY 1),
by_technique AS (
  SELECT alert_id, bool_or(score >= 0.3) AS strong,
    bool_or(score >= 0.15 AND list_has_any(list_transform(string_split(tactic, ','), lambda t: trim(t)),
      ['Impact', 'Exfiltration', 'Credential Access'])) AS impact,
    string_agg(id, ',' ORDER BY rank) AS ids, arg_min(id, rank) AS top_id, arg_min(name, rank) AS top_name,
    arg_min(tactic, rank) AS top_tactic,
    string_agg('- ' || id || ' ' || name || ' (' || tactic || ') [relevance=' || printf('%.2f', score) || ']: '
      || technique_text, chr(10) ORDER BY rank) AS retrieved
  FROM techniques GROUP BY 1),
triaged AS (
  SELECT a.alert_id, a.text, h.*, t.*,
    CASE WHEN coalesce(sure, false) AND coalesce(impact, false) THEN 'critical'
      WHEN coalesce(sure, false) OR (coalesce(hit, false) AND coalesce(impact, false)) THEN 'high'
      WHEN coalesce(hit, false) OR coalesce(strong, false) THEN 'medium' ELSE 'low' END AS severity
  FROM alerts a LEFT JOIN by_hit h ON h.alert_id = a.alert_id LEFT JOIN by_technique t ON t.alert_id = a.alert_id)"""

_SUMMARY = f"""
SELECT alert_id, concat_ws(' ', '{V.SUMMARY_NOTICE}', 'Severity: ' || upper(severity) || '.',
  CASE WHEN named IS NOT NULL THEN 'Known-malicious indicators observed: ' || named || '.'
    ELSE 'No indicators matched the local threat-intel feed.' END,
  CASE WHEN top_id IS NOT NULL THEN 'Alert language most closely resembles ATT&CK technique ' || top_id || ' ('
    || top_name || ', tactic: ' || top_tactic || ').' END,
  'Recommended next steps: isolate affected host(s) if severity is high or critical, pivot on the flagged indicators in '
    || 'EDR/SIEM for related activity, and confirm whether the matched ATT&CK technique aligns with the raw log '
    || 'evidence before closing or escalating the alert.') AS summary
FROM triaged"""

_PROMPT = r"""
SELECT alert_id, CAST(length(prompt) AS BIGINT) AS n_chars, md5(prompt) AS digest FROM (
  SELECT alert_id, concat_ws(chr(10), '## Alert', regexp_replace(text, '^\s+|\s+$', '', 'g'), '',
    '## Extracted indicators', coalesce(listed, '- (none found)'), '', '## Threat-intel enrichment',
    coalesce(explained, '- No indicators matched the local threat-intel feed.'), '',
    '## Retrieved ATT&CK context (RAG)', coalesce(retrieved, '- No closely matching techniques retrieved.'), '',
    '## Heuristic severity: ' || severity) AS prompt
  FROM triaged)"""


_REPORT_JSON = f"""{TRIAGE_SQL},
summarized AS ({_SUMMARY}),
in_json AS (
  SELECT alert_id,
    string_agg('{{"value":' || to_json(value) || ',"category":"' || category || '","context":' || to_json(context) || '}}', ','
      ORDER BY category, value_lc) AS indicators,
    string_agg('{{"value":' || to_json(value) || ',"category":"' || category || '","is_known_malicious":' || is_known_malicious
      || ',"confidence":' || coalesce(to_json(confidence), 'null') || ',"source":' || coalesce(to_json(source), 'null')
      || ',"notes":' || to_json(notes) || '}}', ',' ORDER BY category, value_lc) AS enrichment
  FROM enriched GROUP BY 1),
retrieved_json AS (
  SELECT alert_id, string_agg('{{"id":"' || id || '","name":"' || name || '","tactic":"' || tactic || '","text":'
    || to_json(technique_text) || ',"relevance":' || round(score, 3) || '}}', ',' ORDER BY rank) AS matched
  FROM techniques GROUP BY 1)
SELECT t.alert_id, '{{"alert_text":' || to_json(t.text) || ',"indicators":[' || coalesce(j.indicators, '')
  || '],"enrichment":[' || coalesce(j.enrichment, '') || '],"matched_techniques":[' || coalesce(r.matched, '')
  || '],"severity":"' || severity || '","summary":' || to_json(s.summary) || ',"llm_backed":false}}' AS report
FROM triaged t LEFT JOIN in_json j ON j.alert_id = t.alert_id LEFT JOIN retrieved_json r ON r.alert_id = t.alert_id
JOIN summarized s ON s.alert_id = t.alert_id"""


def _sweep_sql() -> str:
    values = ", ".join(f"({i}, '{k}')" for i, k in enumerate(_SWEEP))
    return f"""WITH {ALERTS_SQL}, keywords(ord, keyword) AS (VALUES {values})
SELECT alert_id, CAST(ord AS BIGINT) AS ord, keyword FROM alerts, keywords WHERE contains(lower(text), keyword)"""


def _octets(values) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_BUNDLED_CORPUS_SQL = "corpus(ord, id, name, tactic, text) AS (VALUES " + ", ".join(
    "(" + ", ".join([str(i), *("'" + c.replace("'", "''") + "'" for c in t)]) + ")"
    for i, t in enumerate(bundled.TECHNIQUES)
) + ")"
_BUNDLED_FEED_SQL = "\nfeed(category, value_lc, confidence, source, notes) AS (VALUES " + ", ".join(
    f"('{c}', lower('{v}'), '{f}', '{s}', '{n}')" for v, c, f, s, n in bundled.FEED
) + ")"
BUNDLED_TRIAGE_SQL = TRIAGE_SQL.replace(CORPUS_SQL, _BUNDLED_CORPUS_SQL).replace(FEED_SQL, _BUNDLED_FEED_SQL)

ORACLES = {
    "alert_scan": _with(ALERTS_SQL, "SELECT alert_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM alerts"),
    "refang": _with(REFANGED_SQL, "SELECT alert_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM refanged"),
    **{f"ioc_{c}": _with(_found_sql([c]), "SELECT alert_id, value, value_lc FROM indicators") for c in V.CATEGORIES},
    "ioc_first_occurrence": _with(INDICATORS_SQL, "SELECT alert_id, category, value, value_lc FROM indicators"),
    "ioc_context": _with(INDICATORS_SQL, "SELECT alert_id, category, value_lc, context FROM indicators"),
    "ioc_sorted": _with(
        INDICATORS_SQL,
        """SELECT a.alert_id, coalesce(string_agg(category || '=' || value_lc, '|' ORDER BY category, value_lc), '') AS listed
FROM alerts a LEFT JOIN indicators i ON i.alert_id = a.alert_id GROUP BY 1""",
    ),
    "intel_feed_last_wins": _with(
        FEED_SQL.replace(" WHERE doc_id % 3 = 0", ""), "SELECT category, value_lc, confidence, source, notes FROM feed"
    ),
    "intel_enrich": _with(
        ENRICHED_SQL, "SELECT alert_id, category, value, is_known_malicious, confidence, source, notes FROM enriched"
    ),
    "intel_enrich_large_feed": _with(
        ENRICHED_SQL, "SELECT alert_id, category, value, is_known_malicious, confidence, source, notes FROM enriched"
    ),
    "network_match": """WITH bases AS (
  SELECT o_orderkey AS owner, o_orderkey % 27 + 6 AS bits, (o_orderkey * 2654435761 + o_custkey * 40503) % 4294967296 AS base,
    CAST(pow(2, 32 - (o_orderkey % 27 + 6)) AS BIGINT) AS size FROM orders),
networks AS (SELECT owner, bits, base - base % size AS first, base - base % size + size - 1 AS last FROM bases),
named AS (
  SELECT *, (first // 16777216) || '.' || (first // 65536 % 256) || '.' || (first // 256 % 256) || '.' || (first % 256)
    || '/' || bits AS network FROM networks),
addressed AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id * 2654435761 + user_id * 40503) % 4294967296
    ELSE (event_id * 2246822519 + user_id) % 4294967296 END AS number FROM events),
found AS (
  SELECT event_id, network, owner FROM addressed JOIN named ON number BETWEEN first AND last
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY bits DESC, network, owner) = 1)
SELECT a.event_id, (number // 16777216) || '.' || (number // 65536 % 256) || '.' || (number // 256 % 256) || '.'
  || (number % 256) AS address, network, owner
FROM addressed a LEFT JOIN found f ON f.event_id = a.event_id""",
    "known_malicious": _with(
        ENRICHED_SQL,
        "SELECT category, value_lc, count(*) AS alerts FROM enriched WHERE is_known_malicious GROUP BY 1, 2",
    ),
    "private_ip_note": f"""
WITH addressed AS (
  SELECT event_id, {_octets((10, 100, 127, 169, 172, 192, 198, 203, 240, 255, 8, 0))}[event_id % 12 + 1] || '.'
    || {_octets((0, 16, 18, 51, 64, 168, 254))}[user_id % 7 + 1] || '.' || {_octets((0, 2, 100, 113))}[event_id % 4 + 1]
    || '.' || (event_id % 256) AS address
  FROM events),
numbered AS (SELECT *, {_number_sql('address')} AS number FROM addressed)
SELECT event_id, address, {_range_test('number')} AS private FROM numbered""",
    "technique_corpus": _with(CORPUS_SQL, "SELECT CAST(ord AS BIGINT) AS ord, id, name, tactic, text FROM corpus"),
    "tokens": _with(
        ALERTS_SQL,
        f"""SELECT alert_id, md5(listed) AS digest, CAST(length(listed) AS BIGINT) AS n_chars
FROM (SELECT alert_id, coalesce(array_to_string({_tokens_sql('text')}, ' '), '') AS listed FROM alerts)""",
    ),
    "term_counts": _with(
        TURNS_SQL + "," + _tf_sql("query", "turns", "alert_id", "text"),
        "SELECT alert_id AS turn_id, term, n, max_n FROM query_tf",
    ),
    "doc_frequency": _with(INDEX_SQL, "SELECT term, df FROM frequency"),
    "smoothed_idf": _with(INDEX_SQL, "SELECT term, round(idf, 6) AS idf FROM idf"),
    "augmented_tf": _with(INDEX_SQL, "SELECT CAST(ord AS BIGINT) AS ord, term, round(tf, 6) AS tf FROM corpus_tf"),
    "tfidf_vectors": _with(INDEX_SQL, "SELECT CAST(ord AS BIGINT) AS ord, term, round(weight, 6) AS weight FROM vectors"),
    "query_vectors": _with(
        TURNS_SQL + "," + _query_sql("turns"), "SELECT alert_id, term, round(weight, 6) AS weight FROM query_vectors"
    ),
    "cosine_scores": _with(
        TURNS_SQL + "," + _query_sql("turns"),
        "SELECT alert_id, CAST(ord AS BIGINT) AS ord, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    ),
    "tfidf_topk": _with(
        ALERTS_SQL + "," + _query_sql("alerts"),
        "SELECT alert_id, CAST(ord AS BIGINT) AS ord, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3",
    ),
    "tfidf_min_score": _with(
        ALERTS_SQL + "," + _query_sql("alerts"),
        "SELECT alert_id, CAST(ord AS BIGINT) AS ord, rank FROM ranked WHERE rank <= 2 AND score > 0.2",
    ),
    "relevance_rounded": _with(
        ALERTS_SQL + "," + _query_sql("alerts"),
        """SELECT alert_id, id, name, tactic, round(score, 3) AS relevance FROM ranked JOIN corpus USING (ord)
WHERE rank <= 3""",
    ),
    "alert_severity": _with(TRIAGE_SQL, "SELECT alert_id, severity FROM triaged"),
    "triage_summary": _with(TRIAGE_SQL, _SUMMARY),
    "alert_triage": _with(
        TRIAGE_SQL,
        """SELECT alert_id, severity, coalesce(n_indicators, 0) AS n_indicators, coalesce(hits, '') AS hits,
  coalesce(ids, '') AS techniques FROM triaged""",
    ),
    "bundled_alert_triage": _with(
        BUNDLED_TRIAGE_SQL, "SELECT alert_id, severity, coalesce(ids, '') AS techniques FROM triaged"
    ),
    "prompt_table": _with(TRIAGE_SQL, _PROMPT),
    "alert_report_json": f"WITH {_REPORT_JSON}",
    "keyword_list": r"""SELECT regexp_replace(lower(line), '^\s+|\s+$', '', 'g') AS keyword, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""",
    "keyword_sweep": _sweep_sql(),
    "keyword_table": r"""WITH words AS (
  SELECT unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM documents),
keywords AS (SELECT DISTINCT substring(w, 3, least(length(w) - 8, 7)) AS keyword FROM words WHERE length(w) >= 11)
SELECT doc_id, keyword FROM documents, keywords WHERE contains(lower(text), keyword)""",
}
