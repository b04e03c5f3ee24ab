"""Inputs of the operators, rendered from the given tables. Each has a twin in SQL next to the queries that use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds, iso, ntz_from_epoch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, *values: str) -> Column:
    result = F.lit(values[-1])
    for i, value in enumerate(values[:-1]):
        result = F.when(index == i, value).otherwise(result)
    return result


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_file, seq, value)``: one syslog line per event, in 1/200 of its time so that windows fill up.

    A third of all users share one address and four tenths one file. Some lines are garbage, some have a date that
    does not exist, some stand later in the file than their time.
    """
    start = 1704067200
    n, u = F.col("event_id"), F.col("user_id")
    offset = F.floor((epoch_seconds(F.col("ts")) - start) / 200)
    late = F.greatest(offset - 20, F.lit(0))
    base = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(u % 10 < 4, "auth-0.log").otherwise(F.concat(F.lit("auth-"), u % 10, F.lit(".log"))).alias("source_file"),
        F.when(u % 3 == 0, "203.0.113.5").otherwise(F.concat(F.lit("198.51.100."), u % 40)).alias("ip"),
        F.when(n % 5 == 0, "root").when(u % 7 == 5, "jürgen").otherwise(F.concat(F.lit("user"), u % 7)).alias("user"),
        ntz_from_epoch(F.when(n % 11 == 3, late).otherwise(offset) + start).alias("t"),
    )
    months = F.array(*(F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    bsd = F.concat(
        F.get(months, F.month("t") - 1),
        F.lit(" "),
        F.lpad(F.day("t").cast("string"), 2, " "),
        F.lit(" "),
        F.substring(F.col("t").cast("string"), 12, 8),
    )
    stamp = F.when(n % 4 < 3, bsd).otherwise(iso(F.col("t")))
    origin = F.concat(F.col("user"), F.lit(" from "), F.col("ip"), F.lit(" port "), 40000 + n % 20000, F.lit(" ssh2"))
    pid = F.concat(F.lit("["), 1000 + n % 9000, F.lit("]: "))
    body = (
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("sshd"), pid, F.lit("Failed password for "), _pick(n % 2, "invalid user ", ""), origin),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("sshd"), pid, F.lit("Accepted "), _pick(n % 2, "password", "publickey"), F.lit(" for "), origin),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(
                F.lit("sudo: "), F.col("user"), F.lit(" : TTY=pts/"), n % 4, F.lit(" ; PWD=/home/"), F.col("user"),
                F.lit(" ; USER="), _pick(n % 2, "root", "ubuntu"), F.lit(" ; COMMAND=/usr/bin/task "), n % 9, F.lit(" "),
            ),
        )
        .when(
            F.col("event_type") == "signup",
            F.concat(
                F.lit("useradd"), pid, F.lit("new user: name="), F.col("user"), F.lit(", UID="), n % 4,
                F.lit(", GID=100, home=/home, shell=/bin/sh"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("crontab"), pid, F.lit("("), F.col("user"), F.lit(") "),
                _pick(n % 3, "REPLACE", "BEGIN EDIT", "END EDIT"), F.lit(" ("), F.col("user"), F.lit(")"),
            )
        )
    )
    value = (
        F.when(n % 97 == 5, F.concat(F.lit("not a syslog line "), n))
        .when(n % 89 == 7, F.concat(stamp, F.lit(" web-1 systemd[1]: Started Session "), n, F.lit(".")))
        .when(n % 101 == 9, F.concat(F.lit("Feb 30 10:00:00 web-1 sshd[1]: "), origin))
        .otherwise(F.concat(stamp, F.lit(" web-1 "), body))
    )
    return base.select("source_file", n.alias("seq"), value.alias("value"))


AUTH_LINES_SQL = """
base AS (
  SELECT event_id AS n, event_type,
    CASE WHEN user_id % 10 < 4 THEN 'auth-0.log' ELSE 'auth-' || (user_id % 10) || '.log' END AS source_file,
    CASE WHEN user_id % 3 = 0 THEN '203.0.113.5' ELSE '198.51.100.' || (user_id % 40) END AS ip,
    CASE WHEN event_id % 5 = 0 THEN 'root' WHEN user_id % 7 = 5 THEN 'jürgen' ELSE 'user' || (user_id % 7) END AS usr,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(
      CASE WHEN event_id % 11 = 3
        THEN greatest((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 200 - 20, 0)
        ELSE (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 200 END) AS t
  FROM events),
stamped AS (
  SELECT *,
    CASE WHEN n % 4 < 3
      THEN ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(t)] || ' '
        || lpad(CAST(day(t) AS VARCHAR), 2, ' ') || ' ' || strftime(t, '%H:%M:%S')
      ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') END AS stamp,
    usr || ' from ' || ip || ' port ' || (40000 + n % 20000) || ' ssh2' AS origin,
    '[' || (1000 + n % 9000) || ']: ' AS pid
  FROM base),
lines AS (
  SELECT source_file, n AS seq,
    CASE WHEN n % 97 = 5 THEN 'not a syslog line ' || n
      WHEN n % 89 = 7 THEN stamp || ' web-1 systemd[1]: Started Session ' || n || '.'
      WHEN n % 101 = 9 THEN 'Feb 30 10:00:00 web-1 sshd[1]: ' || origin
      ELSE stamp || ' web-1 ' || CASE event_type
        WHEN 'error' THEN 'sshd' || pid || 'Failed password for '
          || CASE WHEN n % 2 = 0 THEN 'invalid user ' ELSE '' END || origin
        WHEN 'purchase' THEN 'sshd' || pid || 'Accepted '
          || CASE WHEN n % 2 = 0 THEN 'password' ELSE 'publickey' END || ' for ' || origin
        WHEN 'click' THEN 'sudo: ' || usr || ' : TTY=pts/' || (n % 4) || ' ; PWD=/home/' || usr || ' ; USER='
          || CASE WHEN n % 2 = 0 THEN 'root' ELSE 'ubuntu' END || ' ; COMMAND=/usr/bin/task ' || (n % 9) || ' '
        WHEN 'signup' THEN 'useradd' || pid || 'new user: name=' || usr || ', UID=' || (n % 4)
          || ', GID=100, home=/home, shell=/bin/sh'
        ELSE 'crontab' || pid || '(' || usr || ') '
          || CASE n % 3 WHEN 0 THEN 'REPLACE' WHEN 1 THEN 'BEGIN EDIT' ELSE 'END EDIT' END || ' (' || usr || ')'
        END END AS value
  FROM stamped)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(alert_id, text)``: documents and pages; every second document ends in indicators, plain and defanged."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    tail = F.concat(
        F.lit("\nseen hxxps://evil[.]example[.]com/"), n % 97, F.lit(" then HXXP://x.example.com and hxxp://b[.]example[.]net/q\n"),
        F.lit("by Ops[at]Example.org, ops@example.org; hashes "), F.md5("text"), F.lit(" "), F.sha1("text"), F.lit(" "),
        F.sha2("text", 256), F.lit(" cve-2024-"), 10000 + n % 50, F.lit(" CVE-2024-"), 10000 + n % 50,
        F.lit(" from 185[.]220[.]101[.]"), n % 30, F.lit(" via 10.0."), n % 256, F.lit(".7, 01.2.3.4 (explorer.exe) e.g.com, Malo.ejemplo.es"),
    )
    text = F.when(n % 2 == 0, F.concat(F.col("text"), tail)).otherwise(F.col("text"))
    pages = table(spark, sf_dir, "pages")
    return docs.select(n.alias("alert_id"), text.alias("text")).unionByName(
        pages.select((F.col("page_id") + 1000000000000).alias("alert_id"), F.concat("url", F.lit(" "), "html").alias("text"))
    )


ALERTS_SQL = """
alerts AS (
  SELECT doc_id AS alert_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10)
      || 'seen hxxps://evil[.]example[.]com/' || (doc_id % 97)
      || ' then HXXP://x.example.com and hxxp://b[.]example[.]net/q' || chr(10)
      || 'by Ops[at]Example.org, ops@example.org; hashes ' || md5(text) || ' ' || sha1(text) || ' ' || sha256(text)
      || ' cve-2024-' || (10000 + doc_id % 50) || ' CVE-2024-' || (10000 + doc_id % 50)
      || ' from 185[.]220[.]101[.]' || (doc_id % 30) || ' via 10.0.' || (doc_id % 256)
      || '.7, 01.2.3.4 (explorer.exe) e.g.com, Malo.ejemplo.es'
    ELSE text END AS text
  FROM documents
  UNION ALL SELECT page_id + 1000000000000, url || ' ' || html FROM pages)"""


def feed_entries(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Raw feed ``(pos, value, category, confidence, source, notes)`` with repeated keys in different spellings.

    It knows a third of the documents, so that others are in no feed, or ``every`` one.
    """
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    entries = F.array(
        *(
            F.struct(value.alias("value"), F.lit(category).alias("category"))
            for value, category in (
                (F.upper(F.md5("text")), "md5"),
                (F.concat(F.lit("185.220.101."), n % 20), "ipv4"),
                (F.when(n % 2 == 0, "EVIL.example.com").otherwise("evil.example.com"), "domain"),
            )
        )
    )
    return docs.where(F.lit(True) if every else n % 3 == 0).select(F.col("doc_id").alias("pos"), F.explode(entries).alias("e")).select(
        "pos",
        "e.value",
        "e.category",
        F.when(F.col("pos") % 4 == 0, "high").otherwise("medium").alias("confidence"),
        F.concat(F.lit("feed-"), F.col("pos") % 5).alias("source"),
        F.when(F.col("pos") % 7 != 0, F.concat(F.lit("note "), F.col("pos"))).alias("notes"),
    )


FEED_SQL = """
feed_entries AS (
  SELECT pos, value, category, CASE WHEN pos % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence,
    'feed-' || (pos % 5) AS source, CASE WHEN pos % 7 <> 0 THEN 'note ' || pos END AS notes
  FROM (
    SELECT doc_id AS pos, upper(md5(text)) AS value, 'md5' AS category FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, '185.220.101.' || (doc_id % 20), 'ipv4' FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'EVIL.example.com' ELSE 'evil.example.com' END, 'domain'
      FROM documents WHERE doc_id % 3 = 0)),
feed AS (
  SELECT category, lower(value) AS value_lc, confidence, source, notes FROM feed_entries
  QUALIFY row_number() OVER (PARTITION BY category, lower(value) ORDER BY pos DESC) = 1)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, id, name, tactic, text)``: the benchmark passages as techniques."""
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.cast("int").alias("ord"),
        F.concat(F.lit("B"), i).alias("id"),
        F.concat(F.lit("Passage "), i).alias("name"),
        _pick(i % 4, "Impact", "Execution, Persistence", "Initial Access, Credential Access", "Discovery").alias("tactic"),
        "text",
    )


CORPUS_SQL = """
corpus AS (
  SELECT CAST(item_id AS INTEGER) AS ord, 'B' || item_id AS id, 'Passage ' || item_id AS name,
    CASE item_id % 4 WHEN 0 THEN 'Impact' WHEN 1 THEN 'Execution, Persistence'
      WHEN 2 THEN 'Initial Access, Credential Access' ELSE 'Discovery' END AS tactic,
    text
  FROM benchmark)"""


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw process snapshots from parts, with blanks; a third of them on one host."""
    p = F.col("p_partkey")
    k = p % 60
    name = (
        F.when(k == 1, "mimikatz.exe").when(k == 2, "nmap").when(k == 3, "NetCat.exe").when(k == 4, "certutil.exe")
        .otherwise(F.col("p_name"))
    )
    words = (
        F.when(p % 45 == 4, "powershell.exe -NoLogo -w  hidden -enc SQBFAFgA")
        .when(p % 45 == 5, "cmd /c schtasks /create /tn x")
        .when(p % 45 == 6, "nc -lvp 4444 -e /bin/sh")
        .otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    )
    return table(spark, sf_dir, "part").select(
        F.when(p % 3 == 0, "host-0").otherwise(F.concat(F.lit("host-"), p % 10)).alias("host"),
        ntz_from_epoch(F.lit(1704067200) + (p % 2) * 3600).alias("snapshot_ts"),
        p.alias("seq"),
        p.cast("int").alias("pid"),
        F.when(p % 50 != 7, name).alias("name"),
        F.when(p % 41 != 3, F.concat(F.lit("/opt/"), "p_brand", F.lit("/"), name)).alias("exe"),
        F.when(p % 37 != 5, F.split(words, " ")).alias("cmdline"),
        F.when(p % 31 != 9, F.concat(F.lit("svc"), F.col("p_size") % 5)).alias("username"),
        F.when(p % 29 != 11, F.col("p_retailprice")).alias("create_time"),
    )


PROCESSES_SQL = """
named AS (
  SELECT *, CASE p_partkey % 60 WHEN 1 THEN 'mimikatz.exe' WHEN 2 THEN 'nmap' WHEN 3 THEN 'NetCat.exe'
    WHEN 4 THEN 'certutil.exe' ELSE p_name END AS nm
  FROM part),
processes AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'host-0' ELSE 'host-' || (p_partkey % 10) END AS host,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p_partkey % 2 AS BIGINT)) AS snapshot_ts,
    p_partkey AS seq, p_partkey AS pid,
    CASE WHEN p_partkey % 50 <> 7 THEN nm ELSE '' END AS name,
    CASE WHEN p_partkey % 41 <> 3 THEN '/opt/' || p_brand || '/' || nm ELSE '' END AS exe,
    CASE WHEN p_partkey % 37 = 5 THEN ''
      WHEN p_partkey % 45 = 4 THEN 'powershell.exe -NoLogo -w  hidden -enc SQBFAFgA'
      WHEN p_partkey % 45 = 5 THEN 'cmd /c schtasks /create /tn x'
      WHEN p_partkey % 45 = 6 THEN 'nc -lvp 4444 -e /bin/sh'
      ELSE p_type || ' ' || p_name END AS cmdline,
    CASE WHEN p_partkey % 31 <> 9 THEN 'svc' || (p_size % 5) ELSE '' END AS username,
    CASE WHEN p_partkey % 29 <> 11 THEN p_retailprice ELSE 0.0 END AS create_time
  FROM named)"""
