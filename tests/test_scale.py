"""Hot keys: a third or more of all rows on one address, file, second, indicator or host."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from triagemill.operators import detect, enrich, match, retrieve
from triagemill.plans import auth_triage
from triagemill.plans.staging import new_path, stage
from triagemill.sources import bundled
from triagemill.streaming import watch

START = datetime(2026, 1, 10)


def hot_events(spark, rows=200000):
    """One address with 90 % of all failures, half of them within one second."""
    n = F.col("id")
    hot = n % 10 != 0
    offset = F.when(n % 2 == 0, 5000).otherwise(n % 40000)
    ts = F.lit(START.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset)
    fields = F.struct(
        F.concat(F.lit("u"), n % 5).alias("user"), F.when(hot, "203.0.113.5").otherwise(F.concat(F.lit("10.0.0."), n % 100)).alias("ip"),
        F.lit("amy").alias("invoker"), F.lit("root").alias("target_user"), F.lit("sh").alias("command"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("string").alias("action"),
    )
    kind = F.when((n % 20).isin(1, 2), "ssh_accepted").when(n % 20 == 3, "sudo_command").otherwise("ssh_failed_password")
    return spark.range(rows, numPartitions=8).select(
        F.lit("one.log").alias("source_file"), n.alias("seq"), ts.alias("ts"), kind.alias("kind"), fields.alias("fields")
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_brute_force_limits_groups_before_the_shuffle(spark):
    plan = plan_of(detect.brute_force_clusters(hot_events(spark)))
    partial = plan.index("row_number(), 5, Partial")
    exchange = plan.rindex("Exchange hashpartitioning(", 0, partial)
    final = plan.index("row_number(), 5, Final")
    assert final < exchange < partial


def test_hot_address_is_answered_whole(spark):
    events = hot_events(spark).cache()
    (hit,) = detect.brute_force_clusters(events).where("ip = '203.0.113.5'").collect()
    assert hit.last_ts - hit.first_ts <= timedelta(seconds=60)
    failures = events.where("kind = 'ssh_failed_password' and fields.ip = '203.0.113.5'")
    earliest = failures.orderBy("ts", "seq").limit(5).collect()
    assert hit.first_ts == earliest[0].ts and hit.last_ts == earliest[4].ts

    logins = detect.compromised_logins(events)
    at = START + timedelta(seconds=5001)
    one = logins.where(F.col("ts") == F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")).first()
    since = at - timedelta(seconds=120)
    expected = failures.where(
        (F.col("ts") <= F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"))
        & (F.col("ts") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
    ).count()
    assert one.prior == expected > 50000


def test_counts_shrink_before_they_travel(spark):
    """One row per address and second leaves a task, however many failures there were."""
    seconds = detect.suspect_seconds(hot_events(spark))
    plan = plan_of(seconds)
    assert plan.rindex("partial_count") > plan.rindex("Exchange hashpartitioning(")


def test_correlation_joins_one_row_per_bucket(spark):
    events = hot_events(spark)
    instants = detect.suspect_seconds(events).select("source_file", F.col("ts").alias("instant"))
    flagged = detect.flag_near_prior(detect.root_sudo(events), instants, 600)
    assert flagged.count() == events.where("kind = 'sudo_command'").count()


@pytest.fixture
def no_broadcast(spark):
    """Shuffle joins only, and skew found at a few kilobytes, as if the tables were large."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, plan_of(df)


def test_hot_indicator_is_split_across_tasks(spark, no_broadcast):
    n = F.col("id")
    value = F.when(n % 3 == 0, "evil-c2-panel.com").otherwise(F.concat(F.lit("d"), n, F.lit(".com")))
    found = spark.range(0, 60000, numPartitions=8).select(
        n.alias("alert_id"), F.lit("domain").alias("category"), value.alias("value"), value.alias("value_lc")
    )
    enriched = enrich.enrich(found, enrich.latest_entries(bundled.demo_feed(spark)))
    rows, plan = final_plan(enriched)
    assert len(rows) == 60000 and sum(r.is_known_malicious for r in rows) == 20000
    assert "skew=true" in plan


def test_hot_second_of_logins_is_split_across_tasks(spark, no_broadcast):
    rows, plan = final_plan(detect.compromised_logins(hot_events(spark)))
    assert rows and "skew=true" in plan


def test_hot_term_is_split_across_tasks(spark, no_broadcast):
    """Every query and many passages hold one word; the index is over the broadcast limit."""
    passages = spark.range(40).select(
        F.col("id").cast("int").alias("ord"), F.lit("p").alias("name"), F.concat(F.lit("common word"), F.col("id")).alias("text")
    )
    n = F.col("id")
    texts = spark.range(0, 30000, numPartitions=8).select(n.alias("alert_id"), F.concat(F.lit("common word"), n % 5000).alias("text"))
    rows, plan = final_plan(retrieve.top_techniques(texts, passages, index=stage(retrieve.retrieval_index(passages), "index")))
    assert len(rows) == 3 * 30000 and "skew=true" in plan


def test_hot_fingerprint_in_a_streaming_batch(spark, no_broadcast):
    """One program on every host: the anti join of a batch is whole without broadcasts, and its skew is split."""
    n = F.col("id")
    rows = spark.range(0, 60000, numPartitions=8).select(
        F.concat(F.lit("h"), n).alias("host"), F.lit(START).cast("timestamp_ntz").alias("snapshot_ts"), n.alias("seq"),
        n.cast("int").alias("pid"), F.when(n % 3 < 2, "sshd").otherwise(F.concat(F.lit("p"), n)).alias("name"), F.lit("/x").alias("exe"),
        F.array(F.lit("a")).alias("cmdline"), F.lit("u").alias("username"), F.lit(0.0).alias("create_time"),
    )
    source, out = (new_path(spark, x) for x in ("in", "out"))
    rows.write.parquet(source)
    known = stage(rows.where("seq % 6 = 5").select(F.concat("name", F.lit(":"), "exe").alias("fingerprint")).distinct(), "known")
    watch.start(watch.watch_new(watch.snapshot_stream(spark, source), known), out, new_path(spark, "progress")).awaitTermination()
    assert spark.read.parquet(out).count() == 60000 - 10000
    batch, plan = final_plan(watch.watch_new(spark.read.parquet(source), known))
    assert len(batch) == 50000 and "skew=true" in plan


def test_shuffle_joins_give_the_same_findings(spark, lines):
    texts = [f"Jan 10 03:22:{10 + i} web sshd[1]: Failed password for root from 203.0.113.5 port 1 ssh2" for i in range(6)]
    texts += ["Jan 10 03:23:15 web sshd[7]: Accepted password for root from 203.0.113.5 port 9 ssh2"]
    usual = auth_triage.triage_logs(lines(*texts), default_year=2026).findings.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = auth_triage.triage_logs(lines(*texts), default_year=2026).findings.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, usual)) == sorted(map(repr, shuffled)) and len(usual) == 2


def test_no_shuffle_before_text_has_become_indicators_terms_or_findings(spark):
    alerts = spark.range(10).select(F.col("id").alias("alert_id"), F.lit("see a.com").alias("text"))
    from triagemill.operators.indicators import extract_indicators

    for df in (
        extract_indicators(alerts),
        retrieve.term_counts(alerts, "alert_id", F.col("text")),
    ):
        assert "Exchange" not in plan_of(df)
    processes = spark.range(10).select(
        F.col("id").alias("seq"), F.lit("nmap").alias("name"), F.lit("").alias("exe"), F.array(F.lit("nmap")).alias("cmdline")
    )
    assert "Exchange" not in plan_of(match.evaluate(processes, bundled.DEFAULT_RULES))


def test_each_regex_of_a_line_runs_once(spark, lines):
    from triagemill.operators.parse import parse_syslog

    events = parse_syslog(lines("x"), default_year=2026).where("kind = 'ssh_accepted'").select("ts", "fields.ip")
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Failed password for") == 1 and plan.count("[A-Za-z]{3}") == 1


def test_finding_texts_parse_each_line_once(spark, tmp_path):
    """The detectors read staged events; none of them goes back to the lines."""
    from triagemill.workload import auth

    n = F.col("id")
    kinds = F.array(*(F.lit(k) for k in ("error", "purchase", "click", "signup", "view")))
    events = spark.range(400).select(
        n.alias("event_id"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=n * 200)).alias("ts"),
        (n % 20).alias("user_id"), F.get(kinds, n % 5).alias("event_type"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = auth.finding_texts(spark, str(tmp_path))
    assert "new user" not in plan_of(found)
    expected = detect.all_findings(auth._events(spark, str(tmp_path))).select("source_file", "seq", "type", "title")
    rows = found.select("source_file", "seq", "type", "title")
    assert rows.count() and sorted(rows.collect()) == sorted(expected.collect())
