"""Syslog text lines to typed authentication events.

The whole parse is a narrow stage. Each line meets two regexes, one for its shape and one for its message, and each
regex runs once: the match is rewritten to its groups separated by newlines and split into an array. The arrays come
out of an ``explode``, which drops the lines that have none and keeps later filters on ``kind`` from being pushed
below it, where Catalyst would have to run the regex a second time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.pin import pin
from ..functions.text import UNICODE, capture, strip

# --- Fixed values: shape of a line, shapes of the messages ---------------------------------------------------
LINE = (
    UNICODE
    + r"^(?:([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
    + r"|(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2}))\s+"
    + r"(\S+)\s+([\w./-]+?)(?:\[(\d+)\])?:\s+(.*)$"
)
LINE_GROUPS = 15
# Alternatives are tried in order from the start of the message, so the first class that matches anywhere wins.
MESSAGE = (
    UNICODE
    + r"^(?:.*?Failed password for (invalid user )?(\S+) from ([\d.]+) port (\d+).*"
    + r"|.*?Accepted (\S+) for (\S+) from ([\d.]+) port (\d+).*"
    + r"|(?=.*TTY=.*COMMAND=).*?(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=\S+\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.*)"
    + r"|.*?new user:\s*name=([^,]+),\s*UID=(\d+).*"
    + r"|.*?\((\S+)\)\s*(REPLACE|BEGIN EDIT|END EDIT).*)$"
)
MESSAGE_GROUPS = 15

# Groups of both patterns, by position. Exactly one class of a message has its groups filled, the others are empty.
# An empty text is made null before it is cast: a cast that fails costs more than all the rest of a line.
KIND = f"""
CASE WHEN get(c, 1) != '' THEN '{V.KIND_FAILED}'
     WHEN get(c, 5) != '' THEN '{V.KIND_ACCEPTED}'
     WHEN get(c, 8) != '' THEN '{V.KIND_SUDO}'
     WHEN get(c, 11) != '' THEN '{V.KIND_USERADD}'
     WHEN get(c, 13) != '' THEN '{V.KIND_CRONTAB}'
     ELSE '{V.KIND_OTHER}' END"""
FIELDS = """
named_struct(
  'user', nullif(concat(get(c, 1), get(c, 5), get(c, 13)), ''),
  'invalid_user', CASE WHEN get(c, 1) != '' THEN get(c, 0) != '' END,
  'ip', nullif(concat(get(c, 2), get(c, 6)), ''),
  'port', try_cast(nullif(concat(get(c, 3), get(c, 7)), '') AS INT),
  'method', nullif(get(c, 4), ''),
  'invoker', nullif(get(c, 8), ''),
  'target_user', nullif(get(c, 9), ''),
  'command', CASE WHEN get(c, 8) != '' THEN get(c, 10) END,
  'name', nullif(get(c, 11), ''),
  'uid', try_cast(nullif(get(c, 12), '') AS BIGINT),
  'action', nullif(get(c, 14), ''))"""
MONTH = f"""
CASE WHEN p[5] != '' THEN try_cast(p[6] AS INT)
     WHEN instr('{V.MONTHS}', lower(p[0])) > 0 THEN (instr('{V.MONTHS}', lower(p[0])) + 3) div 4 END"""
DAY, HOUR, MINUTE, SECOND = (
    f"try_cast(if(p[5] != '', p[{iso}], p[{bsd}]) AS INT)" for bsd, iso in ((1, 7), (2, 8), (3, 9), (4, 10))
)


def _timestamp(year: str) -> Column:
    """Null for an impossible date; second 60 and year 0 are impossible here, unlike in SQL."""
    made = f"try_make_timestamp_ntz({year}, {MONTH}, {DAY}, {HOUR}, {MINUTE}, {SECOND})"
    return F.expr(f"CASE WHEN {SECOND} < 60 AND {year} >= 1 THEN {made} END")


def parse_syslog(
    lines: DataFrame,
    default_year: int | None = None,
    as_of: datetime | None = None,
    value: str = "value",
) -> DataFrame:
    """Typed events of every recognizable line; other lines are dropped.

    Every column of ``lines`` but the text is carried along (``source_file`` and ``seq`` by convention).
    ``as_of`` fixes "now" for lines without a year, so that a rerun gives the same years.
    """
    keep = [c for c in lines.columns if c != value]
    raw = F.rtrim(F.col(value), F.lit("\n"))
    shaped = lines.select(*keep, raw.alias("raw")).select(
        *keep, "raw", F.when(~F.contains("raw", F.lit("\n")), capture(F.col("raw"), LINE, LINE_GROUPS)).alias("p")
    )
    now = f"TIMESTAMP_NTZ '{as_of.isoformat(sep=' ')}'" if as_of is not None else "localtimestamp()"
    year = default_year if default_year is not None else f"year({now})"
    ts = _timestamp(f"if(p[5] != '', try_cast(p[5] AS INT), {year})")
    if default_year is None:
        # A time still to come belongs to the year before.
        ts = F.when(ts > F.expr(now), _timestamp(f"year({now}) - 1")).otherwise(ts)
    matched = shaped.select(
        *keep,
        "raw",
        F.explode(
            F.when(
                F.size("p") == LINE_GROUPS,
                F.array(
                    F.struct("p", capture(F.col("p")[14], MESSAGE, MESSAGE_GROUPS).alias("c"), ts.alias("ts"))
                ),
            )
        ).alias("m"),
    )
    parts = matched.select(*keep, "raw", "m.p", "m.c", "m.ts").where("ts IS NOT NULL")
    # Pinned, the fields are an operator of their own. One projection with everything would make a method so long that
    # the JVM leaves it interpreted.
    typed = pin(parts.withColumn("kind", F.expr(KIND)), "fields", F.expr(FIELDS))
    return typed.select(
        *keep,
        "ts",
        F.expr("p[11] AS host"),
        F.expr("p[12] AS process"),
        F.expr("try_cast(nullif(p[13], '') AS INT) AS pid"),
        F.expr("p[14] AS message"),
        "raw",
        "kind",
        _trimmed("command", "name").alias("fields"),
    )


def _trimmed(*names: str) -> Column:
    fields = F.col("fields")
    for name in names:
        fields = fields.withField(name, strip(F.col(f"fields.{name}")))
    return fields


def without_text(events: DataFrame) -> DataFrame:
    """Events without their raw text and what only a reader of it needs; unclassified ones keep their time alone."""
    return events.drop(*(c for c in ("host", "process", "pid", "message", "raw") if c in events.columns))


def security_events(events: DataFrame) -> DataFrame:
    """The part of the events that the detectors read: no unclassified rows, no raw text."""
    return without_text(events).where(F.col("kind") != V.KIND_OTHER)
