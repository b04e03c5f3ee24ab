"""Queries over process snapshots: rules, baselines, counts, reports, watch mode."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import baseline as base_ops
from ..operators import match
from ..operators.match import Rule
from ..operators.rule_index import evaluate_table
from ..plans import process_hunt
from ..plans.staging import new_path
from ..sources import baseline_store
from ..sources import tables as readers
from ..sources.sinks import in_order
from ..sources.bundled import DEFAULT_RULES
from ..streaming import watch
from .tables import PROCESSES_SQL, processes, table

SCANNED_AT = datetime(2024, 1, 2)

# Anchors, alternation, word ends, several fields in another order, a pattern that matches nothing at all.
WORD_RULES = (
    Rule("small-first", r"^small\b", ("name", "exe", "cmdline"), "low", "Discovery", "T1", "starts small"),
    Rule("bolt-or-ring-last", r"(bolt|ring)$", ("cmdline", "name"), "high", "Impact", "T2"),
    Rule("brand-teens", r"brand#1\d/", ("exe",), "critical", "Execution", "T3", "brand in the teens"),
    Rule("words", r"tion in [a-z]+", ("cmdline",), "low", "Discovery", "T5"),
    Rule("anything", r"z*", ("cmdline", "exe"), "medium", "Execution", "T4", "matches the empty string"),
)


def _clean(spark, sf_dir):
    return base_ops.normalized(processes(spark, sf_dir))


def process_snapshot(spark, sf_dir):
    return _clean(spark, sf_dir).select(
        "host", F.col("snapshot_ts").cast("string").alias("snapshot_ts"), "seq", F.col("pid").cast("bigint").alias("pid"),
        "name", "exe", F.size("cmdline").cast("bigint").alias("n_words"), "username", "create_time",
    )


def cmdline_join(spark, sf_dir):
    return _clean(spark, sf_dir).select("seq", match.haystack("cmdline").alias("cmdline"))


def process_fingerprint(spark, sf_dir):
    return _clean(spark, sf_dir).select("seq", base_ops.fingerprint().alias("fingerprint"))


def _baseline_rows(spark, sf_dir):
    return _clean(spark, sf_dir).where("seq % 3 = 0")


def baseline_write(spark, sf_dir):
    """The baseline of all processes, written, and its files read as they are."""
    path = new_path(spark, "baseline")
    readers.write_baseline(_clean(spark, sf_dir), path)
    return spark.read.parquet(path)


def baseline_read(spark, sf_dir):
    path = new_path(spark, "baseline")
    readers.write_baseline(_clean(spark, sf_dir), path, ["host"])
    return readers.read_baseline(spark, path, ["host"])


def baseline_new(spark, sf_dir):
    known = base_ops.fingerprints(_baseline_rows(spark, sf_dir))
    return base_ops.new_processes(_clean(spark, sf_dir), known).select("host", "seq", "fingerprint")


def baseline_new_by_host(spark, sf_dir):
    known = base_ops.fingerprints(_baseline_rows(spark, sf_dir), ["host"])
    return base_ops.new_processes(_clean(spark, sf_dir), known, ["host"]).select("host", "seq", "fingerprint")


def baseline_switch(spark, sf_dir):
    """Update with the snapshot of the first hour, then diff all of them against it."""
    path = new_path(spark, "baseline")
    rows = processes(spark, sf_dir)
    process_hunt.scan_with_baseline(spark, rows.where("seq % 2 = 0"), path, update=True)
    return process_hunt.scan_with_baseline(spark, rows, path).new.select("host", "seq", "fingerprint")


def _two_versions(spark, sf_dir):
    """A store with a version for the first hour and one that has both."""
    path, rows = new_path(spark, "store"), processes(spark, sf_dir)
    for hour in (0, 1):
        baseline_store.update(spark, path, rows.where(F.hour("snapshot_ts") == hour), ["host"])
    return path


def baseline_versions(spark, sf_dir):
    """Every process against each version of a baseline that grew with the hours."""
    path = _two_versions(spark, sf_dir)
    new = [
        base_ops.new_processes(_clean(spark, sf_dir), baseline_store.read(spark, path, ["host"], version=v), ["host"])
        .select(F.lit(v).cast("bigint").alias("version"), "host", "seq", "fingerprint")
        for v in (1, 2)
    ]
    return new[0].unionByName(new[1])


def baseline_history(spark, sf_dir):
    """First and last time of each fingerprint after two updates."""
    history = baseline_store.read(spark, _two_versions(spark, sf_dir), ["host"])
    return history.select("host", "fingerprint", *(F.col(c).cast("string").alias(c) for c in ("first_seen", "last_seen")))


def watch_live_baseline(spark, sf_dir):
    """A watch that learns: the second hour arrives after the first one has become the baseline."""
    folder, store, out, progress = (new_path(spark, name) for name in ("arriving", "store", "found", "progress"))
    rows = processes(spark, sf_dir)
    for hour in (0, 1):
        rows.where(F.hour("snapshot_ts") == hour).write.mode("append").parquet(folder)
        stream = watch.snapshot_stream(spark, folder)
        watch.start_against_store(stream, store, out, progress, learn=True).awaitTermination()
    return watch.found_new(spark, out).select(F.col("batch").cast("bigint").alias("batch"), "host", "seq", "fingerprint")


def _finding_columns(findings):
    return findings.select("seq", "rule_id", "severity", "mitre_tactic", "mitre_technique", "description",
                           "matched_field", "matched_text")


def rule_match_first_field(spark, sf_dir):
    return _finding_columns(match.evaluate(_clean(spark, sf_dir), WORD_RULES))


def rule_evaluate(spark, sf_dir):
    """The bundled rules on every process."""
    return _finding_columns(match.evaluate(_clean(spark, sf_dir), DEFAULT_RULES))


def default_rules_on_texts(spark, sf_dir):
    """The bundled rules on every document and page as if it were a command line."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.lit("").alias("name"), F.col("source").alias("exe"), F.array("text").alias("cmdline")
    )
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1000000000000).alias("seq"), F.lit("").alias("name"), F.col("url").alias("exe"), F.array("html").alias("cmdline")
    )
    return _finding_columns(match.evaluate(texts.unionByName(pages), (*DEFAULT_RULES, *WORD_RULES[3:4])))


def findings_by_severity(spark, sf_dir):
    findings = match.by_severity(match.evaluate(_clean(spark, sf_dir), DEFAULT_RULES))
    return findings.select(F.col("severity_rank").cast("bigint").alias("severity_rank"), "seq", "rule_id")


def _counts(min_severity):
    def query(spark, sf_dir):
        scanned = match.with_rule_hits(_clean(spark, sf_dir), DEFAULT_RULES)
        counts = match.process_counts(scanned, min_severity=min_severity)
        return counts.withColumn("snapshot_ts", F.col("snapshot_ts").cast("string"))

    return query


def scan_pass(spark, sf_dir):
    result = process_hunt.scan(processes(spark, sf_dir), min_severity="high")
    return _finding_columns(result.findings)


def process_report(spark, sf_dir):
    known = base_ops.fingerprints(_baseline_rows(spark, sf_dir))
    result = process_hunt.scan(processes(spark, sf_dir), baseline=known, min_severity="medium")
    report = process_hunt.json_report(result, SCANNED_AT)
    return report.select("host", F.col("snapshot_ts").cast("string").alias("snapshot_ts"), "section", "seq", "line")


def process_documents(spark, sf_dir):
    """Every process report written as text, read back whole, and parsed: what each snapshot's document holds."""
    known = base_ops.fingerprints(_baseline_rows(spark, sf_dir))
    result = process_hunt.scan(processes(spark, sf_dir), baseline=known, min_severity="medium")
    path = new_path(spark, "process-reports")
    report = process_hunt.json_report(result, SCANNED_AT).withColumn("folder", F.concat_ws("@", "host", "snapshot_ts"))
    in_order(report, ("folder", *process_hunt.LINE_KEYS)).select("folder", "line").write.partitionBy("folder").text(path)
    lines = spark.read.text(path, wholetext=True)
    # The parts of a snapshot's folder in the order of their names are its document.
    part = F.struct(F.col("_metadata.file_name").alias("file"), "value")
    whole = lines.select("folder", part.alias("p")).groupBy("folder").agg(F.array_sort(F.collect_list("p")).alias("p"))
    doc = F.from_json(F.array_join("p.value", ""), process_hunt.DOCUMENT)
    return whole.select(doc.alias("d")).select(
        "d.host", "d.snapshot_ts", "d.process_count", "d.finding_count", "d.highest_severity",
        F.size("d.findings").cast("bigint").alias("n_findings"),
        F.get("d.findings", F.lit(0))["severity"].alias("first_severity"),
        F.array_join(F.array_sort(F.transform("d.new_since_baseline", lambda p: p["pid"])), ",").alias("new_pids"),
    )


def rule_file(spark, sf_dir):
    """Rules kept as JSON lines: written, read, validated, and run on every process."""
    path = new_path(spark, "rules")
    rows = [(i, r.id, r.pattern, list(r.match_fields), r.severity.upper(), r.mitre_tactic, r.mitre_technique, r.description or None)
            for i, r in enumerate(WORD_RULES)]
    spark.createDataFrame(rows, readers.RULE_SCHEMA).write.json(path)
    return _finding_columns(match.evaluate(_clean(spark, sf_dir), readers.load_rules(readers.read_rules(spark, path))))


def rule_table(spark, sf_dir):
    """Thousands of rules, made from all long words, as a table; every document is a command line, its source a path."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{13,}"), F.lit(0))).alias("w")).distinct()
    n = F.length("w")
    pattern = (
        F.when(n % 4 == 0, F.concat(F.lit("(^|[ \n])"), "w"))
        .when(n % 4 == 1, F.concat(F.substring("w", 1, 5), F.lit(".?"), F.expr("substring(w, 7)")))
        .when(n % 4 == 2, F.concat(F.lit("("), F.substring("w", 1, 7), F.lit("|"), F.substring("w", 3, 7), F.lit(")[a-z]*")))
        .otherwise(F.concat(F.substring("w", 2, 7), F.lit("[^a-z]+[a-d]")))
    )
    rules = words.select(
        F.monotonically_increasing_id().alias("ord"),
        F.concat(F.lit("word-"), "w").alias("id"),
        pattern.alias("pattern"),
        F.when(n % 2 == 0, F.array(F.lit("exe"), F.lit("cmdline"))).otherwise(F.array(F.lit("cmdline"))).alias("match_fields"),
        F.when(n > 14, "HIGH").otherwise("low").alias("severity"),
        F.lit("Impact").alias("mitre_tactic"),
        F.lit("T1").alias("mitre_technique"),
        F.lit(None).cast("string").alias("description"),
    )
    texts = docs.select(
        F.col("doc_id").alias("seq"), F.lit("").alias("name"), F.col("source").alias("exe"), F.array("text").alias("cmdline")
    )
    return _finding_columns(evaluate_table(texts, rules))


def rule_violations(spark, sf_dir):
    p = F.col("p_partkey")
    fields = (
        F.when(p % 4 == 0, F.array(F.lit("name"))).when(p % 4 == 1, F.array(F.lit("name"), F.lit("exe")))
        .when(p % 4 == 2, F.array(F.lit("cmdline"), F.lit("pid"))).otherwise(F.array(F.lit("path"), F.lit("cwd")))
    )
    severity = (
        F.when(p % 5 == 0, "LOW").when(p % 5 == 1, "medium").when(p % 5 == 2, "High").when(p % 5 == 3, "critical")
        .otherwise("Urgent")
    )
    rules = table(spark, sf_dir, "part").select(
        p.alias("ord"),
        F.when(p % 50 != 1, F.concat(F.lit("rule-"), F.floor(p / 3) * F.when(p % 10 < 2, 1).otherwise(-1), F.lit("-"), p % 10)).alias("id"),
        F.when(p % 43 != 0, F.col("p_name")).alias("pattern"),
        F.when(p % 41 != 0, fields).alias("match_fields"),
        F.when(p % 47 != 0, severity).alias("severity"),
        F.when(p % 37 != 0, F.lit("Impact")).alias("mitre_tactic"),
        F.when(p % 31 != 0, F.lit("T1")).alias("mitre_technique"),
    )
    doubled = rules.unionByName(rules.where("ord % 17 = 3").withColumn("ord", F.col("ord") + 1000000))
    return match.rule_violations(doubled)


def _snapshot_files(spark, sf_dir):
    path = new_path(spark, "snapshots")
    processes(spark, sf_dir).repartition(4, "host").write.parquet(path)
    return path


def _run(stream, spark):
    out = new_path(spark, "watched")
    query = watch.start(stream, out, new_path(spark, "progress"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def watch_findings(spark, sf_dir):
    """The stream over snapshot files, one file per batch, run to its end."""
    stream = watch.snapshot_stream(spark, _snapshot_files(spark, sf_dir), files_per_batch=1)
    return _finding_columns(_run(watch.watch_findings(stream), spark))


def watch_new(spark, sf_dir):
    stream = watch.snapshot_stream(spark, _snapshot_files(spark, sf_dir))
    known = base_ops.fingerprints(_baseline_rows(spark, sf_dir))
    return _run(watch.watch_new(stream, known), spark).select("host", "seq", "fingerprint")


QUERIES = {
    "process_snapshot": process_snapshot,
    "cmdline_join": cmdline_join,
    "process_fingerprint": process_fingerprint,
    "baseline_write": baseline_write,
    "baseline_read": baseline_read,
    "baseline_new": baseline_new,
    "baseline_new_by_host": baseline_new_by_host,
    "baseline_switch": baseline_switch,
    "baseline_versions": baseline_versions,
    "baseline_history": baseline_history,
    "rule_match_first_field": rule_match_first_field,
    "rule_evaluate": rule_evaluate,
    "default_rules_on_texts": default_rules_on_texts,
    "findings_by_severity": findings_by_severity,
    "process_report_counts": _counts("low"),
    "min_severity_filter": _counts("high"),
    "scan_pass": scan_pass,
    "process_report": process_report,
    "process_documents": process_documents,
    "rule_file": rule_file,
    "rule_table": rule_table,
    "rule_violations": rule_violations,
    "watch_findings": watch_findings,
    "watch_new": watch_new,
    "watch_live_baseline": watch_live_baseline,
}

_RANKS = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def _hits_sql(rules, source: str = "processes") -> str:
    """One SELECT per (rule, field), the first field that matches kept."""
    parts = []
    for i, rule in enumerate(rules):
        for j, field in enumerate(rule.match_fields):
            pattern = "(?i)" + rule.pattern.replace("'", "''")
            parts.append(
                f"""SELECT seq, {i} AS rule_ord, {j} AS nth, '{rule.id}' AS rule_id, '{rule.severity}' AS severity,
    {_RANKS[rule.severity]} AS severity_rank, '{rule.mitre_tactic}' AS mitre_tactic,
    '{rule.mitre_technique}' AS mitre_technique, '{rule.description}' AS description, '{field}' AS matched_field,
    regexp_extract({field}, '{pattern}', 0) AS matched_text
  FROM {source} WHERE {field} <> '' AND regexp_matches({field}, '{pattern}')"""
            )
    return (
        "\nhits AS (SELECT * FROM (" + "\n  UNION ALL ".join(parts) + ")"
        "\n  QUALIFY row_number() OVER (PARTITION BY seq, rule_ord ORDER BY nth) = 1)"
    )


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_COLUMNS = "seq, rule_id, severity, mitre_tactic, mitre_technique, description, matched_field, matched_text"
_DEFAULT = PROCESSES_SQL + "," + _hits_sql(DEFAULT_RULES)
_WORDS = PROCESSES_SQL + "," + _hits_sql(WORD_RULES)
_TEXTS = """texts AS (SELECT doc_id AS seq, '' AS name, source AS exe, text AS cmdline FROM documents
  UNION ALL SELECT page_id + 1000000000000, '', url, html FROM pages),""" + _hits_sql(
    (*DEFAULT_RULES, *WORD_RULES[3:4]), "texts"
)
_NEW = """SELECT host, seq, name || ':' || exe AS fingerprint FROM processes p
WHERE name || ':' || exe NOT IN (SELECT name || ':' || exe FROM processes WHERE {})"""


def _counts_sql(min_rank: int) -> str:
    return f"""SELECT host, CAST(snapshot_ts AS VARCHAR) AS snapshot_ts, count(DISTINCT seq) AS process_count,
  count(*) FILTER (severity_rank >= {min_rank}) AS finding_count, arg_max(severity, severity_rank) AS highest_severity
FROM processes LEFT JOIN hits USING (seq) GROUP BY 1, 2"""


_REPORT = _DEFAULT + """,
counts AS (
  SELECT host, snapshot_ts, count(DISTINCT seq) AS process_count, count(*) FILTER (severity_rank >= 1) AS finding_count,
    arg_max(severity, severity_rank) AS highest_severity
  FROM processes LEFT JOIN hits USING (seq) GROUP BY 1, 2),
described AS (
  SELECT *, '{"pid":' || pid || ',"name":"' || name || '","exe":"' || exe || '","cmdline":'
    || CASE WHEN cmdline = '' THEN '[]' ELSE '["' || replace(cmdline, ' ', '","') || '"]' END
    || ',"username":"' || username || '"}' AS process
  FROM processes)"""
_UNKNOWN = "name || ':' || exe NOT IN (SELECT name || ':' || exe FROM processes WHERE seq % 3 = 0)"
_REPORT_LINES = f"""
SELECT host, CAST(snapshot_ts AS VARCHAR) AS snapshot_ts, section, seq, line FROM (
SELECT host, snapshot_ts, 0 AS section, NULL AS seq, '{{"host":"' || host || '","snapshot_ts":"'
  || strftime(snapshot_ts, '%Y-%m-%dT%H:%M:%S') || '","scanned_at":"2024-01-02T00:00:00","process_count":' || process_count
  || ',"finding_count":' || finding_count || ',"highest_severity":'
  || coalesce('"' || highest_severity || '"', 'null') || ',"findings":[' AS line FROM counts
UNION ALL SELECT host, snapshot_ts, 1, seq, CASE WHEN row_number() OVER (PARTITION BY host, snapshot_ts
    ORDER BY severity_rank DESC, seq, rule_ord) = 1 THEN '' ELSE ',' END || '{{"rule_id":"' || rule_id || '","severity":"'
  || severity || '","mitre_tactic":"' || mitre_tactic || '","mitre_technique":"' || mitre_technique || '","description":"'
  || description || '","matched_field":"' || matched_field || '","matched_text":"' || matched_text || '","process":'
  || process || '}}'
FROM hits JOIN described USING (seq) WHERE severity_rank >= 1
UNION ALL SELECT host, snapshot_ts, 2, NULL, '],"new_since_baseline":[' FROM counts
UNION ALL SELECT host, snapshot_ts, 3, seq, CASE WHEN row_number() OVER (PARTITION BY host, snapshot_ts ORDER BY seq) = 1
  THEN '' ELSE ',' END || process FROM described WHERE {_UNKNOWN}
UNION ALL SELECT host, snapshot_ts, 4, NULL, ']}}' FROM counts)"""
_REPORT_CONTENT = f"""
SELECT c.host, strftime(c.snapshot_ts, '%Y-%m-%dT%H:%M:%S') AS snapshot_ts, process_count, finding_count,
  highest_severity, finding_count AS n_findings,
  (SELECT arg_max(h.severity, h.severity_rank) FROM hits h JOIN processes p USING (seq)
    WHERE p.host = c.host AND p.snapshot_ts = c.snapshot_ts AND h.severity_rank >= 1) AS first_severity,
  coalesce((SELECT string_agg(p.pid, ',' ORDER BY p.pid) FROM processes p WHERE p.host = c.host
    AND p.snapshot_ts = c.snapshot_ts AND {_UNKNOWN}), '') AS new_pids
FROM counts c"""

_RULES_SQL = """
once AS (
  SELECT p_partkey AS ord,
    CASE WHEN p_partkey % 50 <> 1 THEN 'rule-' || ((p_partkey // 3) * CASE WHEN p_partkey % 10 < 2 THEN 1 ELSE -1 END)
      || '-' || (p_partkey % 10) END AS id,
    CASE WHEN p_partkey % 43 <> 0 THEN p_name END AS pattern,
    CASE WHEN p_partkey % 41 <> 0 THEN CASE p_partkey % 4 WHEN 0 THEN ['name'] WHEN 1 THEN ['name', 'exe']
      WHEN 2 THEN ['cmdline', 'pid'] ELSE ['path', 'cwd'] END END AS match_fields,
    CASE WHEN p_partkey % 47 <> 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' WHEN 2 THEN 'High'
      WHEN 3 THEN 'critical' ELSE 'Urgent' END END AS severity,
    CASE WHEN p_partkey % 37 <> 0 THEN 'Impact' END AS mitre_tactic,
    CASE WHEN p_partkey % 31 <> 0 THEN 'T1' END AS mitre_technique
  FROM part),
rules AS (SELECT * FROM once UNION ALL SELECT * REPLACE (ord + 1000000 AS ord) FROM once WHERE ord % 17 = 3),
gaps AS (
  SELECT *, concat_ws(', ', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN match_fields IS NULL THEN 'match_fields' END,
    CASE WHEN mitre_tactic IS NULL THEN 'mitre_tactic' END, CASE WHEN mitre_technique IS NULL THEN 'mitre_technique' END,
    CASE WHEN pattern IS NULL THEN 'pattern' END, CASE WHEN severity IS NULL THEN 'severity' END) AS missing
  FROM rules)"""

ORACLES = {
    "process_snapshot": _with(
        PROCESSES_SQL,
        """SELECT host, CAST(snapshot_ts AS VARCHAR) AS snapshot_ts, seq, pid, name, exe,
  CASE WHEN cmdline = '' THEN 0 ELSE len(string_split(cmdline, ' ')) END AS n_words, username, create_time
FROM processes""",
    ),
    "cmdline_join": _with(PROCESSES_SQL, "SELECT seq, cmdline FROM processes"),
    "process_fingerprint": _with(PROCESSES_SQL, "SELECT seq, name || ':' || exe AS fingerprint FROM processes"),
    "baseline_write": _with(
        PROCESSES_SQL, "SELECT DISTINCT name || ':' || exe AS fingerprint FROM processes"
    ),
    "baseline_read": _with(
        PROCESSES_SQL, "SELECT DISTINCT host, name || ':' || exe AS fingerprint FROM processes"
    ),
    "baseline_new": _with(PROCESSES_SQL, _NEW.format("seq % 3 = 0")),
    "baseline_new_by_host": _with(PROCESSES_SQL, _NEW.format("seq % 3 = 0 AND host = p.host")),
    "baseline_switch": _with(PROCESSES_SQL, _NEW.format("seq % 2 = 0")),
    "baseline_versions": _with(
        PROCESSES_SQL,
        """SELECT 1 AS version, host, seq, name || ':' || exe AS fingerprint FROM processes p
WHERE name || ':' || exe NOT IN (SELECT name || ':' || exe FROM processes WHERE seq % 2 = 0 AND host = p.host)
UNION ALL SELECT 2, host, seq, name || ':' || exe FROM processes WHERE false""",
    ),
    "baseline_history": _with(
        PROCESSES_SQL,
        """SELECT host, name || ':' || exe AS fingerprint, CAST(min(snapshot_ts) AS VARCHAR) AS first_seen,
  CAST(max(snapshot_ts) AS VARCHAR) AS last_seen FROM processes GROUP BY 1, 2""",
    ),
    "rule_match_first_field": _with(_WORDS, f"SELECT {_COLUMNS} FROM hits"),
    "rule_evaluate": _with(_DEFAULT, f"SELECT {_COLUMNS} FROM hits"),
    "default_rules_on_texts": _with(_TEXTS, f"SELECT {_COLUMNS} FROM hits"),
    "findings_by_severity": _with(_DEFAULT, "SELECT CAST(severity_rank AS BIGINT) AS severity_rank, seq, rule_id FROM hits"),
    "process_report_counts": _with(_DEFAULT, _counts_sql(0)),
    "min_severity_filter": _with(_DEFAULT, _counts_sql(2)),
    "scan_pass": _with(_DEFAULT, f"SELECT {_COLUMNS} FROM hits WHERE severity_rank >= 2"),
    "process_report": _with(_REPORT, _REPORT_LINES),
    "process_documents": _with(_REPORT, _REPORT_CONTENT),
    "rule_file": _with(_WORDS, f"SELECT {_COLUMNS} FROM hits"),
    "rule_table": r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{13,}')) AS w FROM documents),
rules AS (
  SELECT w, length(w) AS n, '(?i)' || CASE length(w) % 4 WHEN 0 THEN '(^|[ \n])' || w
    WHEN 1 THEN substring(w, 1, 5) || '.?' || substring(w, 7)
    WHEN 2 THEN '(' || substring(w, 1, 7) || '|' || substring(w, 3, 7) || ')[a-z]*'
    ELSE substring(w, 2, 7) || '[^a-z]+[a-d]' END AS pattern FROM words),
hits AS (
  SELECT doc_id, w, n, 'exe' AS field, regexp_extract(source, pattern, 0) AS found FROM documents, rules
  WHERE n % 2 = 0 AND source <> '' AND regexp_matches(source, pattern)
  UNION ALL SELECT doc_id, w, n, 'text', regexp_extract(text, pattern, 0) FROM documents, rules
  WHERE text <> '' AND regexp_matches(text, pattern))
SELECT doc_id AS seq, 'word-' || w AS rule_id, CASE WHEN n > 14 THEN 'high' ELSE 'low' END AS severity,
  'Impact' AS mitre_tactic, 'T1' AS mitre_technique, '' AS description,
  CASE field WHEN 'text' THEN 'cmdline' ELSE 'exe' END AS matched_field, found AS matched_text
FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY field) = 1""",
    "rule_violations": _with(
        _RULES_SQL,
        """SELECT ord AS rule_ord, id AS rule_id, 'missing keys: ' || missing AS violation FROM gaps WHERE missing <> ''
UNION ALL SELECT ord, id, 'invalid severity: ' || lower(severity) FROM rules
WHERE lower(severity) NOT IN ('low', 'medium', 'high', 'critical')
UNION ALL SELECT ord, id, 'invalid match_fields: ' || CASE WHEN list_contains(match_fields, 'pid') THEN 'pid'
  ELSE 'cwd, path' END FROM rules WHERE list_has_any(match_fields, ['pid', 'path', 'cwd'])
UNION ALL SELECT min(ord), id, 'duplicate id' FROM rules WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""",
    ),
    "watch_findings": _with(_DEFAULT, f"SELECT {_COLUMNS} FROM hits"),
    "watch_new": _with(PROCESSES_SQL, _NEW.format("seq % 3 = 0")),
    "watch_live_baseline": _with(
        PROCESSES_SQL,
        "SELECT seq % 2 AS batch, * FROM (" + _NEW.format("seq % 2 = 0 AND p.seq % 2 = 1") + ")",
    ),
}
