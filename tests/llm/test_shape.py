"""Personal data, filter audit and fill-in-the-middle."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from triagemill.llm import fill_in_middle, filter_audit, personal_data, queries

# --- personal data -------------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    """The base patterns as they are written, with their checks."""
    found = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(part) > 255 for part in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), place, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_base_spans_of_random_texts():
    r = random.Random(11)
    for _ in range(20_000):
        text = "".join(r.choice("ab1 2.+-()@@..3 456") for _ in range(r.randint(0, 60)))
        assert [s[:3] for s in personal_data.spans_of(text) if s[3]] == plain_spans(text), text


DISGUISED = [
    ("mail alice at example dot com now", "email", "alice at example dot com"),
    ("alice [at] example [dot] com", "email", "alice [at] example [dot] com"),
    ("write to bob.smith(at)mail.example.org.", "email", "bob.smith(at)mail.example.org"),
    ("John Dot Smith AT mail DOT example DOT co DOT uk", "email", "John Dot Smith AT mail DOT example DOT co DOT uk"),
    ("x аlice@example.com", "email", "аlice@example.com"),
    ("name.42 at mail6.example.com", "email", "name.42 at mail6.example.com"),
    ("jean arobase exemple point fr", "email", "jean arobase exemple point fr"),
    ("a_at_b_dot_com", "email", "a_at_b_dot_com"),
    ("alice＠example.com", "email", "alice＠example.com"),
    ("call plus one five five five one two three four five six seven please", "phone",
     "plus one five five five one two three four five six seven"),
    ("tel: +１ （５５５） １２３-４５６７", "phone", "+１ （５５５） １２３-４５６７"),
    ("+1 (743) 555‑3824", "phone", "+1 (743) 555‑3824"),
    ("+1 5l5 555 O123", "phone", "+1 5l5 555 O123"),
    ("four five five, nine one two double five six seven", "phone", "four five five, nine one two double five six seven"),
    ("ip one nine two dot one six eight dot one dot two zero", "ip", "one nine two dot one six eight dot one dot two zero"),
    ("192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
    ("4111​1111​11111111", "card", "4111​1111​11111111"),
    ("four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
]


@pytest.mark.parametrize("text, kind, part", DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, part):
    padded = "Été – 東京 ​" + text + " …"
    assert (kind, part, False) in [(k, padded[a:b], own) for k, a, b, own in personal_data.spans_of(padded)]


@pytest.mark.parametrize(
    "text",
    [
        "look at example.com for it", "meet me at home. point of it", "one two three four five six seven eight nine ten",
        "5 at example.com", "the dot com boom", "une, deux, trois", "1 one 1 one", "İ at the dot of noon, dot at dot", "at", "", "@",
    ],
)
def test_plain_prose_has_none(text):
    assert personal_data.spans_of(text) == []


def test_long_texts_take_linear_time():
    for unit in ("a", "@", "1", "1.", "+1 ", "one ", "a@", " at a", " dot a", "a_at_", "[ ", "a.b-", "東"):
        personal_data.spans_of(unit * (400_000 // len(unit)))


def test_personal_data(spark):
    rows = odd_rows() + [(20, "é a@b.de"), (21, "x at y dot org, +49 (30) 555-1234"), (21, "x at y dot org, +49 (30) 555-1234")]
    got = personal_data.personal_data(documents(spark, rows, extra=True)).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    by_id = {x.doc_id: x for x in got}
    assert by_id[20].redacted == "é [EMAIL]" and by_id[1].spans == [] and by_id[1].redacted == ""
    assert by_id[21].redacted == "[EMAIL], [PHONE]"
    assert [(s.kind, s.start, s.stop, s.base) for s in by_id[21].spans] == [("email", 0, 14, False), ("phone", 16, 33, True)]
    assert personal_data.personal_data(documents(spark, [])).collect() == []


def test_pii_query_against_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in queries.op11_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        spans = plain_spans(text or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert set(filter(None, text.split(","))) <= set(row.spans.split(","))


# --- filter audit --------------------------------------------------------------------------------------------------


def test_positional_counts():
    r = np.random.default_rng(5)
    for n in (0, 1, 95, 96, 97, 1000, 12_345):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def audit_by_hand(rows, labels):
    """Each order applied to the documents, filter after filter."""
    failed = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        earlier = [i for i, t, _ in rows if (t or "") == text and i is not None]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": bool(earlier) and (doc_id is None or min(earlier) < doc_id),
        }
        marks = [(q, t) for i, q, t in labels if i == doc_id and i is not None]
        failed.append((lang or "", fails, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out, shapley = [], Counter()
    for part in {x[0] for x in failed}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in failed if x[0] == part]
            everyone = left
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                fails = [x for x in everyone if x[1][name]]
                left = [x for x in left if not x[1][name]]
                shapley[part, name] += len(gone)
                alone = sum(sum(x[1].values()) == 1 for x in fails)
                out.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), alone,
                            sum(x[2] for x in gone), sum(x[3] for x in gone), name))
    return sorted((*x[:9], shapley[x[0], x[9]]) for x in out)


def audit_rows(seed, n=80):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("a", "e", "ou", "é", "x", "y", "zz")] + ["LOUD", "#", "a&b", " ", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words[: r.choice([30, 53, 61])], k=r.choice([0, 20, 99, 100, 140])))
        if r.random() < 0.4:
            text = " ".join(f"w{i}{k}" for k in range(r.choice([99, 100, 130])))
        text = r.choice(rows)[1] if rows and r.random() < 0.3 else text.upper() if r.random() < 0.2 else text
        rows.append((r.choice([i, i, i, 3, -i, None]), text, r.choice(["en", "de", "", None])))
    return [*rows, (900, None, "fr"), (901, "", None), (902, "\t \n", "en")]


def test_audit_against_each_order(spark):
    rows = audit_rows(1)
    r = random.Random(2)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(-20, 60), 3, 3, None, None]]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS part")
    docs = documents(spark, rows, extra=True).selectExpr("*", "'clash' AS part", "'clash' AS failed", "'clash' AS digest")
    got = filter_audit.audit(docs, frame).collect()
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(x[c] for c in names) for x in got) == audit_by_hand(rows, labels)


def test_audit_of_nothing_and_of_one_hot_text(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).collect() == []
    hot = documents(spark, [(i, "the same text", "en") for i in range(3000)])
    rows = {(x.filter_order, x.step): x for x in filter_audit.audit(hot, labels).collect()}
    assert len(rows) == 600 and rows["EABCD", 1].removed == 2999 and rows["EABCD", 2].removed == 1
    assert rows["EABCD", 2].redundant == 2999 and rows["AEBCD", 2].removed == 0 and rows["EABCD", 2].unique_fails == 1


# --- fill in the middle --------------------------------------------------------------------------------------------


def middle_by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", a, b - a, out)


def middle_rows():
    r = random.Random(13)
    signs = ["a", "é", "東", "🙂", "\r", "\n", " ", "$1", "\\", "<", "P>", "<S", ">", " ", "\0", "é"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(300)]
    long = "".join(r.choices(["a", "é", "🙂", "\n"], k=fill_in_middle.STRIDE))
    texts += [long, long + "x", long[1:], long * 9 + "end", "x<P>y", "<M>", "<<P", "P>" * 20]
    return [*enumerate(texts), *odd_rows(), (-5, texts[3]), (10**18, texts[4])]


def test_fill_in_middle(spark):
    rows = middle_rows()
    found = fill_in_middle.fill_in_middle(documents(spark, rows, extra=True))
    found = found.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = [(x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in found]
    assert sorted(got, key=repr) == sorted((middle_by_hand(*r) for r in rows), key=repr)
    assert all(x.back == x.text for x in found)
    assert {x.form for x in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(documents(spark, [])).collect() == []


def test_other_markers(spark):
    shape = fill_in_middle.Shape("$1[", "\\s[", "(m", seed="7", plain_percent=0, suffix_first_percent=50)
    rows = [(i, t) for i, t in middle_rows() if i is not None]
    found = fill_in_middle.fill_in_middle(documents(spark, rows), shape)
    found = found.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), shape)).collect()
    assert all(x.back == x.text for x in found) and {"psm", "spm"} <= {x.form for x in found}
    for bad in ("<", "<<", "a<"):
        with pytest.raises(ValueError):
            fill_in_middle.Shape(prefix=bad)


def test_plan_stays_in_built_in_functions(spark):
    plan = fill_in_middle.fill_in_middle(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
