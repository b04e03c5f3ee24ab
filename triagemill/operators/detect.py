"""Detectors: sliding windows, look-back counts and correlation over parsed events.

No detector puts all rows of one address, file or instant in one task. Each first reduces its rows to something whose
size depends on the span of time and not on the amount of data, with map-side combine, and only then runs a window
over a bounded stretch of time. Times are whole seconds, as the parser makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.severity import lookup
from ..functions.text import fill
from ..functions.time import epoch_seconds

SCOPE = "source_file"
TILES_PER_SEGMENT = 1024
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
SECONDS_PER_SEGMENT = 86400

EVIDENCE = (
    "ip STRING, attempt_count BIGINT, users_targeted ARRAY<STRING>, window_seconds INT, user STRING, "
    "prior_failed_attempts BIGINT, invoker STRING, command STRING, correlated_with_compromise BOOLEAN, "
    "name STRING, uid BIGINT"
)


def _evidence(**given: Column) -> Column:
    members = []
    for field in EVIDENCE.split(", "):
        name, dtype = field.split()
        members.append(given.get(name, F.lit(None)).cast(dtype).alias(name))
    return F.struct(*members)


def _finding(
    rows: DataFrame,
    *,
    type_: str,
    severity: Column,
    title: Column,
    description: Column,
    evidence: Column,
    first_seen: str,
    last_seen: str,
    detector_rank: int,
) -> DataFrame:
    return rows.select(
        SCOPE,
        F.lit(type_).alias("type"),
        severity.alias("severity"),
        lookup(severity, V.AUTH_SEVERITY_RANK).alias("severity_rank"),
        title.alias("title"),
        description.alias("description"),
        evidence.alias("evidence"),
        F.col(first_seen).alias("first_seen"),
        F.col(last_seen).alias("last_seen"),
        F.lit(detector_rank).alias("detector_rank"),
        "seq",
    )


def _logins(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind).select(
        SCOPE, "seq", "ts", F.col("fields.ip").alias("ip"), F.col("fields.user").alias("user")
    )


def brute_force_clusters(
    events: DataFrame,
    window_seconds: int = V.BRUTE_FORCE_WINDOW_SECONDS,
    threshold: int = V.BRUTE_FORCE_THRESHOLD,
) -> DataFrame:
    """Per address, the first ``threshold`` failures that lie within ``window_seconds`` of each other, ends included.

    Time is cut into tiles one window long. If a tile holds ``threshold`` failures of an address, the first cluster
    ends at or before the last of them, so later rows of the tile cannot be part of it and a group limit, which Spark
    applies before the shuffle, removes them. What is left is bounded per tile; it is looked at in segments of many
    tiles, each with a copy of the tile before it, because a cluster spans two tiles at most.
    """
    if threshold < 1 or window_seconds < 0:
        raise ValueError("threshold must be at least 1 and window_seconds at least 0")
    most = int(events.sparkSession.conf.get(GROUP_LIMIT_SETTING, "1000"))
    if threshold > most:
        # Spark would then send whole tiles, however hot, to one task.
        raise ValueError(f"threshold is over {most}; raise {GROUP_LIMIT_SETTING} first")
    tile = F.floor(epoch_seconds(F.col("ts")) / max(window_seconds, 1))
    in_tile = Window.partitionBy(SCOPE, "ip", "tile").orderBy("ts", "seq")
    candidates = (
        _logins(events, V.KIND_FAILED)
        .withColumn("tile", tile)
        .withColumn("rn", F.row_number().over(in_tile))
        .where(F.col("rn") <= threshold)
        .drop("rn")
    )
    in_segment = Window.partitionBy(SCOPE, "ip", "segment").orderBy("ts", "seq")
    own, following = (F.floor((F.col("tile") + n) / TILES_PER_SEGMENT) for n in (0, 1))
    spans = (
        candidates.withColumn("segment", F.explode(F.array_distinct(F.array(own, following))))
        .withColumn("first_ts", F.lag("ts", threshold - 1).over(in_segment))
        .withColumn("users", F.collect_set("user").over(in_segment.rowsBetween(1 - threshold, 0)))
    )
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_seconds))
    return (
        spans.where(F.col("ts") - F.col("first_ts") <= width)
        .groupBy(SCOPE, "ip")
        .agg(
            F.min_by(
                F.struct("first_ts", F.col("ts").alias("last_ts"), F.array_sort("users").alias("users")),
                F.struct("ts", "seq"),
            ).alias("hit")
        )
        .select(SCOPE, "ip", "hit.*")
    )


def brute_force(
    events: DataFrame,
    window_seconds: int = V.BRUTE_FORCE_WINDOW_SECONDS,
    threshold: int = V.BRUTE_FORCE_THRESHOLD,
) -> DataFrame:
    """One HIGH finding per address; its place among equals is that of the address's first failure in the file."""
    first_seq = _logins(events, V.KIND_FAILED).groupBy(SCOPE, "ip").agg(F.min("seq").alias("seq"))
    hits = brute_force_clusters(events, window_seconds, threshold).join(first_seq, [SCOPE, "ip"])
    ip, users = F.col("ip"), F.col("users")
    count, window = F.lit(threshold), F.lit(window_seconds)
    return _finding(
        hits,
        type_="brute_force",
        severity=F.lit("HIGH"),
        title=fill(V.BRUTE_FORCE_TITLE, ip),
        description=fill(V.BRUTE_FORCE_TEXT, count, ip, window, F.array_join(users, ", ")),
        evidence=_evidence(ip=ip, attempt_count=count, users_targeted=users, window_seconds=window),
        first_seen="first_ts",
        last_seen="last_ts",
        detector_rank=0,
    )


def suspect_seconds(
    events: DataFrame,
    lookback_seconds: int = V.COMPROMISE_LOOKBACK_SECONDS,
    min_prior_failures: int = V.COMPROMISE_MIN_FAILURES,
) -> DataFrame:
    """(Address, second) pairs with an accepted login and enough failures in the look-back, both ends included.

    Failures and logins are first counted per (address, second), which combines map-side however hot the address.
    The look-back then runs over those seconds, a day at a time with a copy of the seconds the next day looks back
    on. ``first_ts`` is the time of the failure that stands first in the file, not of the earliest.
    """
    if min_prior_failures < 1 or lookback_seconds < 0:
        raise ValueError("min_prior_failures must be at least 1 and lookback_seconds at least 0")
    span = max(SECONDS_PER_SEGMENT, lookback_seconds + 1)
    failed = F.col("kind") == V.KIND_FAILED
    seconds = (
        events.where(F.col("kind").isin(V.KIND_FAILED, V.KIND_ACCEPTED))
        .select(SCOPE, "seq", "ts", "kind", F.col("fields.ip").alias("ip"))
        .groupBy(SCOPE, "ip", "ts")
        .agg(
            F.count_if(failed).alias("failures"),
            F.min(F.when(failed, F.col("seq"))).alias("first_failure"),
            F.bool_or(~failed).alias("has_login"),
        )
        .withColumn("epoch", epoch_seconds(F.col("ts")))
    )
    own, following = (F.floor((F.col("epoch") + n) / span) for n in (0, lookback_seconds))
    look_back = (
        Window.partitionBy(SCOPE, "ip", "segment").orderBy("epoch").rangeBetween(-lookback_seconds, 0)
    )
    first = F.when(F.col("failures") > 0, F.struct(F.col("first_failure"), F.col("ts")))
    return (
        seconds.withColumn("own", own)
        .withColumn("segment", F.explode(F.array_distinct(F.array(F.col("own"), following))))
        .withColumn("prior", F.sum("failures").over(look_back))
        .withColumn("first_ts", F.min(first).over(look_back)["ts"])
        .where(F.col("has_login") & (F.col("segment") == F.col("own")) & (F.col("prior") >= min_prior_failures))
        .select(SCOPE, "ip", "ts", "prior", "first_ts")
    )


def compromised_logins(
    events: DataFrame,
    lookback_seconds: int = V.COMPROMISE_LOOKBACK_SECONDS,
    min_prior_failures: int = V.COMPROMISE_MIN_FAILURES,
) -> DataFrame:
    """Every accepted login of a suspect second, each judged alone."""
    suspect = suspect_seconds(events, lookback_seconds, min_prior_failures)
    return _logins(events, V.KIND_ACCEPTED).join(suspect, [SCOPE, "ip", "ts"])


def compromise_after_brute_force(
    events: DataFrame,
    lookback_seconds: int = V.COMPROMISE_LOOKBACK_SECONDS,
    min_prior_failures: int = V.COMPROMISE_MIN_FAILURES,
) -> DataFrame:
    """One CRITICAL finding per accepted login that follows failures of its address."""
    ip, user, prior = F.col("ip"), F.col("user"), F.col("prior")
    return _finding(
        compromised_logins(events, lookback_seconds, min_prior_failures),
        type_="compromise_after_brute_force",
        severity=F.lit("CRITICAL"),
        title=fill(V.COMPROMISE_TITLE, user),
        description=fill(V.COMPROMISE_TEXT, ip, user, prior, F.lit(lookback_seconds)),
        evidence=_evidence(ip=ip, user=user, prior_failed_attempts=prior),
        first_seen="first_ts",
        last_seen="ts",
        detector_rank=1,
    )


def flag_near_prior(rows: DataFrame, instants: DataFrame, seconds: int, flag: str = "correlated") -> DataFrame:
    """Add a flag: is there an instant of the same scope with ``0 <= ts - instant <= seconds``?

    A range semi-join without any join on ranges. Time is cut into buckets of ``seconds``; a row can only be near
    instants of its own bucket or of the one before, and there the smallest of the former and the largest of the
    latter decide. The instants shrink to those two numbers per bucket, so the join is one to one on
    (scope, bucket) and multiplies nothing.
    """
    if seconds < 0:
        raise ValueError("seconds must be at least 0")
    width = max(seconds, 1)

    def bucket(ts: str) -> Column:
        return F.floor(epoch_seconds(F.col(ts)) / width)

    marks = F.array(
        F.struct(bucket("instant").alias("bucket"), F.lit(True).alias("own")),
        F.struct((bucket("instant") + 1).alias("bucket"), F.lit(False).alias("own")),
    )
    edges = (
        instants.select(SCOPE, "instant", F.explode(marks).alias("m"))
        .groupBy(SCOPE, F.col("m.bucket").alias("bucket"))
        .agg(
            F.min(F.when(F.col("m.own"), F.col("instant"))).alias("first_own"),
            F.max(F.when(~F.col("m.own"), F.col("instant"))).alias("last_before"),
        )
    )
    reach = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    near = (F.col("first_own") <= F.col("ts")) | (F.col("ts") - F.col("last_before") <= reach)
    return (
        rows.withColumn("bucket", bucket("ts"))
        .join(edges, [SCOPE, "bucket"], "left")
        .withColumn(flag, F.coalesce(near, F.lit(False)))
        .drop("bucket", "first_own", "last_before")
    )


def root_sudo(events: DataFrame) -> DataFrame:
    return events.where((F.col("kind") == V.KIND_SUDO) & (F.col("fields.target_user") == "root")).select(
        SCOPE, "seq", "ts", F.col("fields.invoker").alias("invoker"), F.col("fields.command").alias("command")
    )


def privilege_escalation(events: DataFrame, compromises: DataFrame | None = None) -> DataFrame:
    """A finding per ``sudo`` to root: CRITICAL soon after any compromise of the same scope, MEDIUM otherwise.

    ``compromises`` are findings or logins with ``source_file`` and ``last_seen``; without them nothing correlates.
    """
    rows = root_sudo(events)
    if compromises is None:
        rows = rows.withColumn("correlated", F.lit(False))
    else:
        instants = compromises.select(SCOPE, F.col("last_seen").alias("instant"))
        rows = flag_near_prior(rows, instants, V.ESCALATION_CORRELATION_SECONDS)
    invoker, command, correlated = F.col("invoker"), F.col("command"), F.col("correlated")
    return _finding(
        rows,
        type_="privilege_escalation",
        severity=F.when(correlated, "CRITICAL").otherwise("MEDIUM"),
        title=fill(V.ESCALATION_TITLE, invoker),
        description=F.concat(
            fill(V.ESCALATION_TEXT, invoker, command), F.when(correlated, V.ESCALATION_SUFFIX).otherwise("")
        ),
        evidence=_evidence(invoker=invoker, command=command, correlated_with_compromise=correlated),
        first_seen="ts",
        last_seen="ts",
        detector_rank=2,
    )


def persistence(events: DataFrame) -> DataFrame:
    """Accounts created with UID 0 (CRITICAL) and replaced crontabs (MEDIUM), both in one pass."""
    name, uid, user = F.col("fields.name"), F.col("fields.uid"), F.col("fields.user")
    is_account = (F.col("kind") == V.KIND_USERADD) & (uid == 0)
    is_crontab = (F.col("kind") == V.KIND_CRONTAB) & (F.col("fields.action") == "REPLACE")
    rows = events.where(is_account | is_crontab).withColumn("account", F.col("kind") == V.KIND_USERADD)
    account = F.col("account")
    severity = F.when(account, "CRITICAL").otherwise("MEDIUM")
    return _finding(
        rows,
        type_="persistence",
        severity=severity,
        title=F.when(account, fill(V.ROOT_ACCOUNT_TITLE, name)).otherwise(fill(V.CRONTAB_TITLE, user)),
        description=F.when(account, fill(V.ROOT_ACCOUNT_TEXT, name)).otherwise(fill(V.CRONTAB_TEXT, user)),
        evidence=_evidence(user=F.when(~account, user), name=F.when(account, name), uid=F.when(account, uid)),
        first_seen="ts",
        last_seen="ts",
        detector_rank=3,
    ).withColumn(
        "type",
        F.when(F.col("severity") == "CRITICAL", "persistence_root_account").otherwise("persistence_crontab"),
    )


def all_findings(
    events: DataFrame,
    window_seconds: int = V.BRUTE_FORCE_WINDOW_SECONDS,
    threshold: int = V.BRUTE_FORCE_THRESHOLD,
) -> DataFrame:
    """Findings of every detector. ``ORDER_KEYS`` put them in report order; the frame itself is left unsorted.

    Each detector reads only the kinds it needs, so events stored by kind are read about twice in all.
    """
    instants = suspect_seconds(events).withColumnRenamed("ts", "last_seen")
    return (
        brute_force(events, window_seconds, threshold)
        .unionByName(compromise_after_brute_force(events))
        .unionByName(privilege_escalation(events, instants))
        .unionByName(persistence(events))
    )


ORDER_KEYS = ("first_seen", "detector_rank", "seq")
