"""Reference tables and snapshots: feeds, technique corpora, rules, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.baseline import fingerprints
from ..operators.enrich import latest_entries
from ..operators.match import Rule, invalid_patterns, rule_violations

FEED_SCHEMA = (
    "indicators ARRAY<STRUCT<value: STRING, category: STRING, confidence: STRING, source: STRING, notes: STRING>>"
)
TECHNIQUE_SCHEMA = "techniques ARRAY<STRUCT<id: STRING, name: STRING, tactic: STRING, text: STRING>>"
FEED_ENTRY_SCHEMA = "pos BIGINT, value STRING, category STRING, confidence STRING, source STRING, notes STRING"
TECHNIQUE_LINE_SCHEMA = "ord INT, id STRING, name STRING, tactic STRING, text STRING"
RULE_SCHEMA = (
    "ord INT, id STRING, pattern STRING, match_fields ARRAY<STRING>, severity STRING, mitre_tactic STRING, "
    "mitre_technique STRING, description STRING"
)
PROCESS_SCHEMA = (
    "host STRING, snapshot_ts TIMESTAMP_NTZ, seq BIGINT, pid INT, name STRING, exe STRING, cmdline ARRAY<STRING>, "
    "username STRING, create_time DOUBLE"
)


def read_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Feed documents ``{"indicators": [...]}`` as a lookup table with unique keys.

    A document is read as one row, so this is for feeds kept by hand. The last entry wins; of several documents, that
    of the later file name. Large feeds come as lines: ``read_feed_lines``.
    """
    doc = spark.read.schema(FEED_SCHEMA).json(path, multiLine=True)
    own = doc.select(F.col("_metadata.file_path").alias("file"), F.posexplode("indicators").alias("pos", "e"))
    return latest_entries(own.select(F.struct("file", "pos").alias("pos"), "e.*"))


def read_feed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A feed of one JSON entry per line as a lookup table with unique keys; the entry with the largest ``pos`` wins."""
    return latest_entries(spark.read.schema(FEED_ENTRY_SCHEMA).json(path))


def read_techniques(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Corpus documents ``{"techniques": [...]}`` as ``(ord, id, name, tactic, text)``.

    ``ord`` counts on from one file to the next in the order of their names.
    """
    doc = spark.read.schema(TECHNIQUE_SCHEMA).json(path, multiLine=True)
    sized = doc.select(F.col("_metadata.file_path").alias("file"), "techniques", F.size("techniques").alias("n"))
    # One row per file, kept by hand; the sizes alone meet in one task.
    before = sized.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).cast("int").alias("before"))
    own = sized.join(before, "file").select("before", F.posexplode("techniques").alias("ord", "t"))
    return own.select((F.col("before") + F.col("ord")).alias("ord"), "t.*")


def read_technique_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A corpus of one JSON technique per line, with ``ord`` as a column of the data."""
    return spark.read.schema(TECHNIQUE_LINE_SCHEMA).json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Raw rules, one JSON object per line, with ``ord`` as a column of the data."""
    return spark.read.schema(RULE_SCHEMA).json(path)


class InvalidRules(ValueError):
    """The rule table breaks its own requirements; the message lists how."""


#: More rules than this are a mistake, not configuration.
MOST_RULES = 10_000


def load_rules(rules: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """Validated rules as configuration for the plan: at most ``most`` of them, with at most as many messages."""
    rows = rules.orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidRules(f"more than {most} rules")
    problems = [f"{r.rule_id}: {r.violation}" for r in rule_violations(rules).limit(most).collect()]
    if problems:
        raise InvalidRules("; ".join(problems))
    bad = set(invalid_patterns(rules.sparkSession, [r.pattern for r in rows]))
    if bad:
        raise InvalidRules("; ".join(f"{r.id}: invalid regex" for r in rows if r.pattern in bad))
    return [
        Rule(
            r.id,
            r.pattern,
            tuple(r.match_fields),
            r.severity.lower(),
            r.mitre_tactic,
            r.mitre_technique,
            r.description or "",
        )
        for r in rows
    ]


def write_baseline(processes: DataFrame, path: str, scope: Sequence[str] = ()) -> None:
    """The distinct fingerprints, sorted within the files; replaces what was there."""
    keys = [*scope, "fingerprint"]
    found = fingerprints(processes, scope)
    found.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str, scope: Sequence[str] = ()) -> DataFrame:
    """The fingerprints of a baseline, distinct as the writer left them."""
    schema = ", ".join(f"{c} STRING" for c in (*scope, "fingerprint"))
    return spark.read.schema(schema).parquet(path).where(F.col("fingerprint").isNotNull())
