"""Exact, substring and near dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, id_key, odd_rows, repeating_rows, without_repeats
from pyspark.sql import functions as F

from triagemill.llm import exact_dedup, similar_sets, simhash, substring_dedup, suffix_dedup


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


# --- exact ---------------------------------------------------------------------------------------------------------


def test_exact_duplicates(spark):
    rows = odd_rows() + [(100 + i, "copy") for i in range(50)]
    got = exact_dedup.exact_duplicates(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    expected = sorted(
        (str(d), str(min(groups[normal(t)], key=id_key)), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest())
        for d, t in rows
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    # One row of each group stays, rows that repeat an id included.
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact_duplicates(spark):
    docs = documents(spark, odd_rows(), extra=True)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    texts = [normal(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({normal(t) for _, t in odd_rows()})
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).collect() == []


def test_clashing_names_and_maps_stay(spark):
    docs = documents(spark, odd_rows()).selectExpr("*", "'a' AS __sha", "'b' AS __KEEP", "'c' AS __n", "map('k', doc_id) AS m", "'d' AS __key")
    for operator in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        got = operator(docs)
        assert got.columns == docs.columns
        assert {(r["__sha"], r["__KEEP"], r["__n"], r["__key"]) for r in got.collect()} == {("a", "b", "c", "d")}


def test_cuckoo_index_grows_deletes_and_verifies():
    index = exact_dedup.CuckooIndex(buckets=2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    # Equal fingerprints and buckets, other digests: only the comparison tells them apart.
    twins = [d[:10] + bytes(22) for d in digests[:200]]
    for i, d in enumerate([*digests, *twins, *digests[:100]]):
        index.add(d, i, 1)
    assert index.size == 5200 and index.mask + 1 >= 2048
    assert all(index.find(d)[1] == i for i, d in enumerate(digests))
    assert [index.find(d)[2] for d in digests[:101]] == [2] * 100 + [1]
    assert all(index.remove(d) for d in digests[:3000]) and not index.remove(digests[0])
    assert index.find(digests[0]) is None and index.find(twins[0]) is not None
    assert sum(1 for _ in index.entries()) == index.size == 2200


def test_index_updates(spark):
    docs = documents(spark, [(i, f"text {i % 30}") for i in range(60)])
    index = exact_dedup.build_index(exact_dedup.text_digests(docs)).cache()
    gone = index.where("keep_id < 10").select("text_sha256")
    left = exact_dedup.remove_digests(index, gone)
    assert sorted(r.keep_id for r in left.collect()) == list(range(10, 30))
    later = exact_dedup.build_index(exact_dedup.text_digests(documents(spark, [(5, "text 12"), (99, "new")])))
    merged = {r.keep_id: r.group_size for r in exact_dedup.merge_indexes(index, later).collect()}
    assert merged[5] == 2 and merged[99] == 1 and len(merged) == 32 - 1 + 0 or 12 not in merged


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []


# --- bytes and words -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rows = repeating_rows(seed)
    got = suffix_dedup.remove_repeated_bytes(documents(spark, rows, extra=True)).withColumn("h", F.sha2("kept", 256))
    expected = without_repeats(rows, 50, lambda t: t, bytes)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got.collect()], key=str) == expected
    assert sum(e[2] for e in expected) > 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words(spark, seed):
    rows = repeating_rows(seed)
    got = substring_dedup.remove_repeated_words(documents(spark, rows, extra=True)).withColumn("h", F.sha2("kept", 256))
    expected = [(a, b, c, h) for a, b, c, _, h in without_repeats(rows, 13, bytes.split, b" ".join)]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.h) for r in got.collect()], key=str) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 200


def test_a_passage_in_every_document(spark):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(120))
    rows = [(i, f"{i * 7919:09d}{passage}{i * 104729:09d}") for i in range(300)]
    got = suffix_dedup.remove_repeated_bytes(documents(spark, rows).repartition(6)).collect()
    expected = [(a, b, c, d) for a, b, c, d, _ in without_repeats(rows, 50, lambda t: t, bytes)]
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got], key=str) == expected
    assert all(r.n_removed >= 120 for r in got if r.doc_id)


def test_odd_rows_and_long_documents(spark):
    rows = odd_rows()
    by_bytes = suffix_dedup.remove_repeated_bytes(documents(spark, rows)).collect()
    by_words = substring_dedup.remove_repeated_words(documents(spark, rows)).collect()
    expected = [(a, b, c, h) for a, b, c, _, h in without_repeats(rows, 13, bytes.split, b" ".join)]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in by_words], key=str) == expected
    # The second long text, which begins with the first, shows that documents over several parts are whole.
    expected = [(a, b, c, d) for a, b, c, d, _ in without_repeats(rows, 50, lambda t: t, bytes)]
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in by_bytes], key=str) == expected
    for operator in (suffix_dedup.remove_repeated_bytes, substring_dedup.remove_repeated_words):
        assert operator(documents(spark, [])).collect() == []


def thue_morse(n, a="a", b="b"):
    """Words of this kind and their complements have equal polynomial hashes modulo powers of two."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_with_equal_polynomial_hashes(spark):
    start = " ".join(f"word{i}" for i in range(12))
    rows = [(1, f"{start} {thue_morse(2048)}"), (2, f"{start} {thue_morse(2048, 'b', 'a')}")]
    docs = documents(spark, rows).coalesce(1)
    assert [x.n_removed for x in substring_dedup.remove_repeated_words(docs).collect()] == [0, 0]
    again = documents(spark, [*rows, (3, rows[1][1])]).coalesce(1)
    assert {x.doc_id: x.n_removed for x in substring_dedup.remove_repeated_words(again).collect()} == {1: 0, 2: 0, 3: 13}
    alone = documents(spark, [(1, thue_morse(2048)), (2, thue_morse(2048, "b", "a"))])
    assert len(simhash.drop_near_duplicates(alone).collect()) == 2


def test_seeds_are_extended_both_ways(spark):
    """Repeats of exactly the window and one word less, cut off by other words at either side."""
    r = random.Random(3)
    base = [f"v{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        at, n = r.randrange(380), r.choice([11, 12, 13, 14, 20])
        rows.append((i, " ".join([f"x{i}", *base[at : at + n], f"y{i}", *base[(at + 40) % 380 :][:n]])))
    got = substring_dedup.remove_repeated_words(documents(spark, rows)).withColumn("h", F.sha2("kept", 256))
    expected = [(a, b, c, h) for a, b, c, _, h in without_repeats(rows, 13, bytes.split, b" ".join)]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.h) for r in got.collect()], key=str) == sorted(expected, key=str)


def test_passages_beyond_the_first_stretch(spark):
    """Texts of several stretches that share passages at other places, with each other and with a short text."""
    r = random.Random(6)
    say = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passages = [say(r.randint(60, 300)) for _ in range(40)]
    first, second = say(300_000), say(330_000)
    for passage in passages:
        first += passage + say(r.randint(7000, 8000))
        second += say(r.randint(7000, 8000)) + passage
    rows = [(1, first), (2, second + say(500)), (3, "short " + passages[5] + say(80)), (0, passages[6] + say(90))]
    assert min(len(first), len(second)) > 600_000
    got = suffix_dedup.remove_repeated_bytes(documents(spark, rows)).withColumn("h", F.sha2("kept", 256)).collect()
    expected = without_repeats(rows, 50, lambda t: t, bytes)
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.h) for x in got], key=str) == expected
    assert {e[0]: e[3] for e in expected}[2] >= 40


def test_multikey_groups():
    r = np.random.default_rng(5)
    rows = r.integers(0, 3, (4000, 5)).astype(np.uint64)
    rank = suffix_dedup.multikey_groups(list(rows.T))
    distinct = np.unique(rows, axis=0)
    assert (distinct[rank] == rows).all()


# --- near ----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(id, print) pairs to the smallest id of each component, over all pairs."""
    groups = []
    for i, p in prints:
        near = [g for g in groups if any(bin(p ^ q).count("1") <= 3 for _, q in g)]
        groups = [g for g in groups if g not in near] + [[(i, p), *(x for g in near for x in g)]]
    return {i: min((j for j, _ in g), key=id_key) for g in groups for i, _ in g}


def test_fingerprints_and_components(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 200)))) for i in range(80)]
    for i in range(80, 200):
        w = r.choice(rows)[1].split(" ")
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w).title()))
    rows += odd_rows()
    got = simhash.near_duplicates(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    expected = sorted((str(d), f"{plain_fingerprint(t):016x}") for d, t in rows)
    assert sorted((str(x.doc_id), x.fingerprint) for x in got) == expected
    named = plain_components([(k, plain_fingerprint(t)) for k, (_, t) in enumerate(rows)])
    smallest = {}
    for k, (d, _) in enumerate(rows):
        smallest.setdefault(named[k], []).append(d)
    want = sorted((f"{plain_fingerprint(t):016x}", str(min(smallest[named[k]], key=id_key))) for k, (_, t) in enumerate(rows))
    assert sorted((x.fingerprint, str(x.component_id)) for x in got) == want


def test_keys_find_every_pair_within_the_distance():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 3000).astype(np.uint64)
    other = base.copy()
    for k in range(3):
        flip = r.integers(0, 64, 3000).astype(np.uint64)
        other ^= np.where(r.random(3000) < 0.95, np.uint64(1) << flip, np.uint64(0))
    keys = [set() for _ in range(6000)]
    for row, key in zip(*simhash.fuzzy_keys(np.concatenate([base, other]))):
        keys[row].add(int(key))
    assert all(keys[i] & keys[i + 3000] for i in range(3000))


def test_large_keys_are_split(spark):
    """Fingerprints of one dense cluster; the key they share is over the bound, so tiles compare them."""
    center = 0x0123456789ABCDEF
    prints = [center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)] + [center]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "print long")
    found = simhash.components(simhash.links(df)).collect()
    assert len({x.node for x in found} | {x.root for x in found}) == len(prints)
    assert len({x.root for x in found}) == 1


def test_one_document_of_each_component_stays(spark):
    text = " ".join(f"word{i}" for i in range(300))
    docs = documents(spark, [(5, text), (3, text + " more"), (3, text), (9, "other words entirely here"), (None, text)], extra=True)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == [3, 9]
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_texts_without_an_id_or_with_equal_ids_are_judged_by_their_own(spark):
    r = random.Random(8)
    say = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(200))
    texts = [say() for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:6]] + [(7, texts[6]), (None, texts[6]), (6, texts[7]), (5, texts[7])]
    rows += [(None, texts[0]), (None, texts[1].title()), (5, texts[4]), (None, None), (None, "")]
    got = simhash.drop_near_duplicates(documents(spark, rows, extra=True)).collect()
    assert sorted((x.text or "").lower() for x in got) == sorted(["", *texts])
    ids = {(x.text or "").lower(): x.doc_id for x in got}
    assert [ids[t] for t in texts] == [None] * 4 + [5, 5, 7, 5]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_of_five_word_shingles_go(spark):
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    rows, near, far = [], 0, 0
    for i in range(150):
        words = say(r.randint(90, 160))
        rows.append((2 * i, " ".join(words)))
        copy = list(words)
        for at in r.sample(range(5, len(words) - 5), r.choice([1, 1, 2, 2, 12])):
            copy[at] = "changed"
        rows.append((2 * i + 1, " ".join(copy).title()))
        similar = jaccard(rows[-1][1], rows[-2][1])
        near, far = near + (similar >= 0.8), far + (similar < 0.6)
    kept = {x.doc_id for x in simhash.drop_near_duplicates(documents(spark, rows, extra=True)).collect()}
    pairs = [jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(150)]
    assert kept == {2 * i for i in range(150)} | {2 * i + 1 for i in range(150) if pairs[i] < 0.8}
    assert near > 90 and far > 10


def test_a_large_group_of_near_copies_settles(spark):
    """One group whose members resemble each other in steps, beside sets that share much and are not similar."""
    r = random.Random(21)
    words = [f"g{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(words)
        words[r.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(words)))
    shared = [f"s{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*shared, *(f"o{i}x{k}" for k in range(40))])) for i in range(200)]
    kept = {x.doc_id for x in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    assert kept == {0, *range(1000, 1200)}


def test_shingle_sets():
    texts = ["", "One two", "a b c d e f a b c d e", "x " * 50, " lead  and\ttrail \n"]
    for text, got in zip(texts, similar_sets.shingle_sets([t.encode() for t in texts])):
        w = text.lower().split()
        assert len(got) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
