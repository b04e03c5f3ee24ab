"""Keyword and rule tables: their indexes against plain searches, and plans that do not grow with the entries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from triagemill.operators import bloom, enrich, networks
from triagemill.operators.keywords import sweep_table
from triagemill.operators.match import Rule, evaluate
from triagemill.operators.rule_index import evaluate_table, required
from triagemill.sources import text
from triagemill.sources.tables import RULE_SCHEMA

LETTERS = "abcdefgh é🙂"


def word(r, *sizes):
    return "".join(r.choices(LETTERS, k=r.choice(sizes)))


def test_keyword_table_against_plain_search(spark):
    r = random.Random(1)
    docs = [(i, word(r, 0, 3, 50, 9000)) for i in range(60)] + [(None, None), (None, "ABC"), (5, "abc"), (5, "abc")]
    keywords = [(i, word(r, 1, 2, 3, 4, 5, 6)) for i in range(3000)]
    keywords += [(3001, ""), (3002, None), (3003, "ab"), (3004, "ab"), (3004, "ab"), (3005, "🙂abc"), (3006, "🙂🙂🙂🙂")]
    found = sweep_table(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(keywords, "ord int, keyword string"), "id")
    expected = [(i, o, k) for i, t in docs for o, k in keywords if k is not None and k in (t or "").lower()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_a_hundred_thousand_keywords(spark):
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(100)) for _ in range(300)]
    keywords = list({"".join(r.choices("abcdefghij", k=6)) for _ in range(120_000)})[:100_000]
    assert len(keywords) == 100_000
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = sweep_table(docs, spark.createDataFrame(list(enumerate(keywords)), "ord int, keyword string"), "id").collect()
    numbers = {k: i for i, k in enumerate(keywords)}
    expected = {(i, numbers[t[a : a + 6]]) for i, t in enumerate(texts) for a in range(len(t) - 5) if t[a : a + 6] in numbers}
    assert len(found) == len(expected) and {(x.id, x.ord) for x in found} == expected


def test_no_keywords_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    none = spark.createDataFrame([], "ord int, keyword string")
    assert sweep_table(docs, none, "id").collect() == []
    assert sweep_table(docs.limit(0), spark.createDataFrame([(1, "a")], none.schema), "id").collect() == []


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("k"))
    asked = spark.range(40_000).select("id", F.col("id").cast("string").alias("k"))
    kept = [x.id for x in asked.where(bloom.might_hold(bloom.bloom_filter(F.col("k"), keys), F.col("k"))).collect()]
    assert set(range(0, 40_000, 2)) <= set(kept) and len(kept) < 20_400


@pytest.mark.parametrize(
    "pattern, strings",
    [
        (r"powershell.*-enc", ["powershell"]), (r"(cmd|powershell)\.exe", ["cmd.exe", "powershell.exe"]), (r"\d+", [""]),
        (r"https?://x", ["http://x", "https://x"]), (r"a[bc]d+e", ["abd", "acd"]), (r"^Small\b", ["small"]), (r"z*", [""]),
        (r"(abc){2,3}def", ["def"]), (r"x(?=foo)bar", ["bar"]), (r"abc|", [""]), (r"[[a]bcd]", [""]), (r"abc\v", [""]),
        (r"(?x) abc", [""]), (r"\Qab\E", [""]), (r"abc(", [""]), (None, [""]), (r"Straße", ["stra"]),
    ],
)
def test_required_strings(pattern, strings):
    assert required(pattern) == strings


def random_pattern(r, depth=0):
    k = r.random()
    if depth > 3 or k < 0.45:
        return r.choice(["a", "b", "A", "x1", "foo", r"\.", r"\d", "[ab]", "[^a]", ".", r"\w", "é", " ", "-", r"\b", "[a-c]", "k", "s"])
    one, two = random_pattern(r, depth + 1), random_pattern(r, depth + 1)
    if k < 0.65:
        return one + two
    if k < 0.75:
        return f"({one}|{two})"
    return f"(?:{one}){r.choice(['*', '+', '?', '{2}', '{0,2}', '{1,3}', '+?'])}" if k < 0.85 else f"({one})"


def test_no_match_without_a_required_string():
    r = random.Random(3)
    matched = 0
    for _ in range(10_000):
        pattern = random_pattern(r)
        strings = required(pattern)
        for _ in range(5):
            text = "".join(r.choices(["a", "b", "c", "x1", "foo", ".", "1", "é", " ", "-", "K", "S"], k=r.randint(0, 8)))
            if re.search(pattern, text, re.I):
                matched += 1
                assert any(s in text.lower() for s in strings), (pattern, strings, text)
    assert matched > 5000


FIELDS = ("name", "exe", "cmdline")


def process_rows(r, n):
    say = lambda: "".join(r.choices(["foo", "a", "b", "x1", "ſ", "K", "İ", ".", " ", "S", "1"], k=r.randint(0, 12)))
    rows = [("h", i, say(), say(), [say() for _ in range(r.randint(0, 3))]) for i in range(n)]
    return [*rows, ("h", 0, "foo", "foo", ["foo"]), (None, None, "foo", None, None), (None, None, "foo", None, None)]


def test_rule_table_against_rules_as_columns(spark):
    r = random.Random(4)
    rows = spark.createDataFrame(process_rows(r, 60), "host string, seq long, name string, exe string, cmdline array<string>")
    patterns = [random_pattern(r) for _ in range(120)] + ["sing|king", "ping", r"\d{2}", "^foo$", "FOO", ""]
    rules = [Rule(f"r{i}", p, tuple(r.sample(FIELDS, r.randint(1, 3))), r.choice(["low", "high"]), "t", "T", "d") for i, p in enumerate(patterns)]
    table = spark.createDataFrame(
        [(i, x.id, x.pattern, list(x.match_fields), x.severity.upper(), "t", "T", "d") for i, x in enumerate(rules)], RULE_SCHEMA
    )
    expected, got = evaluate(rows, rules), evaluate_table(rows, table)
    assert got.columns == expected.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    assert len(expected.collect()) > 500


def test_the_plan_does_not_grow_with_the_rules(spark):
    r = random.Random(5)
    rows = spark.createDataFrame(process_rows(r, 30), "host string, seq long, name string, exe string, cmdline array<string>")

    def plan_and_rows(n):
        own = [(i, f"r{i}", f"foo[a-z]{{{i % 7}}}x?{i}", ["cmdline"], "low", "t", "T", None) for i in range(n)]
        found = evaluate_table(rows, spark.createDataFrame(own, RULE_SCHEMA))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
        return plan.count("\n"), found.count()

    small, large = plan_and_rows(10), plan_and_rows(5000)
    assert small[0] == large[0] and large[1] >= small[1]


# --- feeds, networks, line numbers ---------------------------------------------------------------------------------


def indicators(spark, n):
    rows = [(i, "ipv4", f"10.0.{i % 200}.{i % 50}", f"10.0.{i % 200}.{i % 50}") for i in range(n)]
    rows += [(-1, "domain", "A.example", "a.example"), (-2, "md5", None, None), (None, None, "x", "x"), (-1, "domain", "A.example", "a.example")]
    return spark.createDataFrame(rows, "alert_id long, category string, value string, value_lc string")


def test_large_feed_gives_the_rows_of_the_plain_join(spark):
    found = indicators(spark, 3000)
    entries = [("ipv4", f"10.0.{i}.{i % 50}", "high", "f", None if i % 3 else "n") for i in range(0, 200, 20)]
    entries += [("domain", "a.example", None, None, None)] + [("url", f"http://{i}", "low", "g", "") for i in range(20_000)]
    feed = spark.createDataFrame(entries, "category string, value_lc string, confidence string, source string, notes string")
    got, expected = enrich.enrich_from_large_feed(found, feed), enrich.enrich(found, feed)
    assert got.columns == expected.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    hits = expected.where("is_known_malicious").count()
    maybe, rest = enrich.maybe_known(found, *enrich.feed_filter(feed))
    # Only hits and few others would be shuffled.
    assert 0 < hits <= maybe.count() <= hits + 0.2 * found.count() and maybe.count() + rest.count() == found.count()
    none = feed.limit(0)
    assert enrich.enrich_from_large_feed(found, none).where("is_known_malicious").count() == 0


def test_most_specific_of_a_hundred_thousand_networks(spark):
    r = random.Random(7)
    tables = {b: {} for b in range(33)}
    rows = []
    for i in range(100_000):
        bits = r.choice([0, 8, 12, 16, 20, 24, 28, 31, 32]) if i else 0
        first = r.getrandbits(32) >> (32 - bits) << (32 - bits)
        rows.append((".".join(str(first >> s & 255) for s in (24, 16, 8, 0)) + f"/{bits}", i))
    rows += [("10.1.2.3", 200_000), ("300.1.1.1/8", -1), ("1.2.3/8", -2), ("1.2.3.4/33", -3), (None, -4), ("x", -5)]
    for network, owner in rows[:-5]:
        base, _, bits = network.partition("/")
        bits = int(bits or 32)
        number = sum(int(o) << s for o, s in zip(base.split("."), (24, 16, 8, 0)))
        held = tables[bits].setdefault(number >> (32 - bits), (network, owner))
        tables[bits][number >> (32 - bits)] = min(held, (network, owner))
    asked = [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(500)]
    asked += [n.partition("/")[0] for n, _ in r.sample(rows[:-5], 500)] + ["10.1.2.3", "10.1.2.3"]

    def best(address):
        number = sum(int(o) << s for o, s in zip(address.split("."), (24, 16, 8, 0)))
        return next((tables[b][number >> (32 - b)] for b in range(32, -1, -1) if number >> (32 - b) in tables[b]), (None, None))

    addresses = spark.createDataFrame([(a,) for a in asked] + [(None,), ("1.2.3",), ("a.b.c.d",)], "address string")
    found = networks.most_specific(addresses, spark.createDataFrame(rows, "network string, owner long"))
    expected = [(a, *best(a)) for a in asked] + [(None, None, None), ("1.2.3", None, None), ("a.b.c.d", None, None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    empty = networks.most_specific(addresses, spark.createDataFrame([], "network string, owner long"))
    assert {x.owner for x in empty.collect()} == {None} and empty.count() == len(expected)


@pytest.mark.parametrize("most_splits", [500_000, 0])
def test_line_numbers_of_files_in_many_splits(spark, tmp_path, monkeypatch, most_splits):
    monkeypatch.setattr(text, "MOST_SPLITS", most_splits)
    r = random.Random(8)
    expected = []
    for name, n in (("a.log", 3000), ("b.log", 1), ("c.log", 0), ("d.log", 5000)):
        texts = ["" if r.random() < 0.1 else "x" * r.randint(1, 60) + str(i) for i in range(n)]
        (tmp_path / name).write_text("".join(t + "\n" for t in texts))
        expected += [(name, i, t) for i, t in enumerate(texts)]
    words = tmp_path / "k"
    words.mkdir()
    (words / "words.txt").write_text(" Nmap\n\ncmd.exe \n" * 3000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path / "*.log")).rdd.getNumPartitions() > 20
        found = text.read_numbered(spark, str(tmp_path / "*.log")).collect()
        keywords = text.read_numbered_keywords(spark, str(words)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((x.source_file.rpartition("/")[2], x.seq, x.value) for x in found) == sorted(expected)
    assert [(w.ord, w.keyword) for w in keywords] == list(enumerate(["nmap", "", "cmd.exe"] * 3000))
