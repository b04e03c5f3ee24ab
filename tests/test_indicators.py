import random
import re

import pytest

from triagemill.functions import fixed_values as V
from triagemill.operators.indicators import extract_indicators, refang, with_indicators

# What a value of each category looks like as a whole.
WHOLE = {
    "url": f"(?i){V.URL_PATTERN[2:]}",
    "email": f"{V.EMAIL_LOCAL}+@{V.EMAIL_HOST}",
    "cve": f"(?i){V.CVE_PATTERN}",
    "ipv4": V.IPV4_PATTERN,
    "domain": rf"(?:{V.DOMAIN_LABEL}\.)+{V.DOMAIN_ENDING}",
    **{name: f"[a-fA-F0-9]{{{n}}}" for n, name in V.HEX_CATEGORY.items()},
}


@pytest.fixture
def extract(spark):
    def run(*texts, **options):
        alerts = spark.createDataFrame(list(enumerate(texts)), "alert_id long, text string")
        return extract_indicators(alerts, **options).orderBy("alert_id", "category", "value_lc").collect()

    return run


def test_refang(spark):
    rows = [("hxxps://bad[.]org/p",), ("1[.]2[.]3[.]4",), ("me[at]x.org",), ("HXXP://a(.)b[:]9[@]",)]
    frame = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in frame.select(refang(frame.t)).collect()] == ["https://bad.org/p", "1.2.3.4", "me@x.org", "HXXP://a.b:9@"]


def test_every_category(extract):
    text = (
        "Got https://bad-host.org/a.bin from mal@bad-host.org, "
        "0cc175b9c0f1b6a831c399e269772661 uses CVE-2021-44228 via 8.8.4.4"
    )
    assert {(r.category, r.value) for r in extract(text)} == {
        ("url", "https://bad-host.org/a.bin"), ("email", "mal@bad-host.org"), ("domain", "bad-host.org"),
        ("md5", "0cc175b9c0f1b6a831c399e269772661"), ("cve", "CVE-2021-44228"), ("ipv4", "8.8.4.4"),
    }


def test_first_spelling_stays(extract):
    assert [r.value for r in extract("Ask Me@Site.org or me@site.org") if r.category == "email"] == ["Me@Site.org"]


@pytest.mark.parametrize("text", ["", "Python 3.12.1", "01.2.3.4", "explorer.exe and j.morales", "é1.2.3.4", None])
def test_no_indicator(extract, text):
    assert extract(text) == []


def test_category_choice_and_array_form(spark, extract):
    text = "a.com 1.1.1.1 b.org"
    assert [r.value for r in extract(text, categories=["ipv4"])] == ["1.1.1.1"]
    alerts = spark.createDataFrame([(1, text), (2, "none")], "alert_id long, text string")
    sizes = {r.alert_id: len(r.indicators) for r in with_indicators(alerts).collect()}
    assert sizes == {1: 3, 2: 0}


def test_long_dotted_runs(extract):
    labels = "a." * 50000
    found = extract(f"x@y.org {labels}com {'1.2.3.' * 20000} end", context=True)
    assert {(r.category, len(r.value)) for r in found} >= {("domain", 100003), ("email", 7)}


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_against_plain_search(extract, seed):
    rng = random.Random(seed)
    words = [
        "a", "b-", "-", ".", "..", "com", "org.", "co-x", "net", "x", "é", "_", "@", "@", "%", "+", " ", "\n", "1.2.3.4", "10.0.0.1.",
        "cve-2020-12345", "http://", "https://q", "0cc175b9c0f1b6a831c399e269772661", "d" * 40, "e" * 64, "z" * 70, ")", '"', "7", "\r", "ſ",
    ]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(700)]
    texts = [t for t in texts if "[" not in t and "(.)" not in t]
    by_text = {}
    for r in extract(*texts):
        by_text.setdefault(r.alert_id, []).append(r)
    for i, text in enumerate(texts):
        rows = by_text.get(i, [])
        assert len({(r.category, r.value_lc) for r in rows}) == len(rows)
        for r in rows:
            check_row(r, text)
        check_nothing_is_missed(rows, text)


def check_row(r, text):
    """A value has its category's form, stands in the text inside its context, and no equal one stands before it."""
    assert re.fullmatch(WHOLE[r.category], r.value), (r, text)
    assert r.value_lc == r.value.lower()
    flat = text.replace("\n", " ")
    places = [m.start() for m in re.finditer(f"(?={re.escape(r.value)})", text)]
    around = {flat[max(0, p - V.CONTEXT_RADIUS) : p + len(r.value) + V.CONTEXT_RADIUS].strip() for p in places}
    assert r.context in around, (r, text)
    if r.category == "domain":
        assert r.value_lc.rpartition(".")[2] in V.TOP_LEVEL_DOMAINS
    if r.category == "ipv4":
        assert all(str(int(o)) == o and int(o) < 256 for o in r.value.split("."))


def check_nothing_is_missed(rows, text):
    """Values set apart by blanks are certain to be indicators; each has its row, whatever its spelling."""
    found = {(r.category, r.value_lc) for r in rows}
    for word in text.split():
        for category in ("cve", "md5", "sha1", "sha256"):
            if word.isascii() and re.fullmatch(WHOLE[category], word):
                assert (category, word.lower()) in found, (word, text)
        if word in ("1.2.3.4", "a@x.com", "http://a.com/x"):
            assert any(v == word for _, v in found), (word, text)


def test_expected_rows(extract):
    """Written by hand: neighbours, cases, ends of texts, characters beyond ASCII, and what only looks alike."""
    text = (
        "A@b-c.org,x@y.co.uk;HTTPS://Q.com/(a) 1.2.3.4.5 256.1.1.1 1.02.3.4 CVE-2020-1234 cve-2020-12345678 "
        "é.com ü@x.net sub.example.es foo.exe 0CC175B9C0F1B6A831C399E269772661 0cc175b9c0f1b6a831c399e26977266"
    )
    assert {(r.category, r.value) for r in extract(text)} == {
        ("email", "A@b-c.org"), ("email", "x@y.co.uk"), ("url", "HTTPS://Q.com/(a"),
        ("domain", "b-c.org"), ("domain", "y.co.uk"), ("domain", "Q.com"), ("domain", "x.net"), ("domain", "sub.example.es"),
        ("ipv4", "1.2.3.4"), ("cve", "CVE-2020-1234"), ("md5", "0CC175B9C0F1B6A831C399E269772661"),
    }


@pytest.mark.parametrize("ending", ["es", "museum", "wiki", "pw", "com", "ninja", "coop", "za"])
def test_rare_endings(extract, ending):
    assert [r.value for r in extract(f"see Bad-Host.{ending}.") if r.category == "domain"] == [f"Bad-Host.{ending}"]
