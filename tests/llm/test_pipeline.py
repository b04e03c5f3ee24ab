"""Decontamination, the pipeline, and how they are registered."""

import hashlib
import random
import re

import __spark_entry__
import corpus_pipeline
import pytest
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from triagemill.llm import decontaminate


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(rows, items, window=10):
    windows = {}
    for item_id, text in items:
        words = plain_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        words = plain_words(text)
        hit, found = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(words[i : i + n])]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((str(doc_id), len(words), sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), any(hit)))
    return sorted(out)


def cases(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "東京", "x1"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 2, 5, 9, 10, 11, 30])))) for i in range(25)]
    items += [(3, items[4][1]), (None, items[5][1]), (40, None)]
    rows = []
    for i in range(120):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            own = plain_words(r.choice(items)[1])
            a = r.randint(0, len(own))
            text[(k := r.randint(0, len(text))) : k] = own[a : a + r.randint(1, 25)]
        rows.append((i, r.choice([" ", ", ", "\n-"]).join(text).title()))
    return rows + odd_rows(), items


@pytest.mark.parametrize("most_words", [1_000_000, 60])
def test_contamination(spark, most_words):
    rows, items = cases(most_words)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, rows, extra=True), bench, most_words=most_words).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == plain_contamination(rows, items)
    assert any(x.contaminated for x in got) and not all(x.contaminated for x in got)


def test_long_items_in_pieces(spark):
    long = " ".join(f"t{i}" for i in range(200))
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    rows = [(i, " ".join(f"t{j}" for j in range(i, i + 10))) for i in range(0, 191)]
    got = decontaminate.contamination(documents(spark, rows), bench, most_words=50).collect()
    assert all(x.n_hit == 10 and x.n_items == 1 for x in got) and len(got) == 191


def test_nothing_to_compare(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(documents(spark, odd_rows()), bench).collect()
    assert len(got) == len(odd_rows()) and not any(x.contaminated for x in got)
    assert decontaminate.contamination(documents(spark, []), bench).collect() == []


def test_cutting(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12))), (2, "short item")], "item_id long, text string")
    tail = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "clean text"), (2, "before " + " ".join(f"Q{i}" for i in range(1, 11)) + " " + tail), (3, f"One Short, ITEM! two {tail}"), (4, None), (5, "short item")]
    docs = documents(spark, rows, extra=True)
    got = decontaminate.decontaminate(docs, bench)
    assert got.columns == docs.columns
    kept = {x.doc_id: x for x in got.collect()}
    assert set(kept) == {1, 3, 4} and kept[3].text == f"One two {tail}" and kept[3].n_chars == len(kept[3].text)
    assert kept[1].n_chars == 10 and kept[4].text is None


@pytest.mark.parametrize("coverage", [0.2, 1.0])
def test_cutting_with_several_automata(spark, coverage):
    rows, items = cases(3)
    fill = lambda n: " ".join(f"f{r}" for r in range(n))
    # Short items that cover 28 % of a text, of which an automaton of 60 words sees at most half.
    items += [(100 + i, f"s{i} t{i}") for i in range(60)]
    rows += [(500, " ".join(f"s{i} t{i} {fill(5)}" for i in range(60))), (501, f"s1 t1 {fill(20)} s40 t40")]
    # Windows that hold a short item, which another automaton may see first.
    for k in range(30):
        item = [f"m{k}x{i}" for i in range(12)]
        items += [(200 + k, " ".join(item)), (300 + k, " ".join(item[4:6]))]
        rows.append((600 + k, " ".join([*item[:10], fill(60)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, extra=True).withColumn("__spans", F.lit("clash"))

    def cut(most_words):
        got = decontaminate.decontaminate(docs, bench, coverage=coverage, most_words=most_words)
        assert got.columns == docs.columns
        return sorted(map(str, got.collect()))

    whole = cut(decontaminate.AUTOMATON_WORDS)
    assert cut(60) == whole and 0 < len(whole) < len(rows)
    assert not any("m0x0" in row for row in whole)


def test_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    r = random.Random(12)
    langs = {"en": ["the", "and", "tion", "ing", "er"], "de": ["ung", "sch", "heit", "zu", "ber"]}
    say = lambda lang, n: " ".join("".join(r.choice(langs[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang, 120), lang) for i in range(60) for lang in [r.choice(["en", "de"])]]
    item = say("en", 20)
    rows += [(100, rows[7][1].replace(" ", "  "), "en"), (101, rows[8][1] + " ing", None), (102, "12 34 !", "en"), (103, None, "en"), (104, say("en", 50) + " " + item, "en")]
    sf = str(tmp_path)
    documents(spark, rows, extra=True).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    ids = sorted(x.doc_id for x in got)
    assert ids == list(range(60))
    assert all(x.round_trip for x in got)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert function(spark, docs.limit(0), sf).collect() == [], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
