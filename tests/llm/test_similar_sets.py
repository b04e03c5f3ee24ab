"""Links between sets of shingles where very many share a key."""

import random

import numpy as np
import pytest
from helpers import documents

from triagemill.llm import similar_sets, simhash


def linked(spark, texts, bands):
    found = similar_sets.shingle_sets([t.encode() for t in texts])
    ids = [int(np.array(similar_sets.set_id(s), np.uint64).view(np.int64)) for s in found]
    sets = spark.createDataFrame([(s, str(i), bands) for i, s in enumerate(ids)], "set long, key string, bands array<long>")
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    roots = similar_sets.set_links(sets, docs, spark.createDataFrame([], "a long, b long"), simhash.components)
    named = {r.node: r.root for r in roots.collect()}
    return [named.get(s, s) for s in ids], found


def similarity(one, two):
    both = len(np.intersect1d(one, two))
    return both / (len(one) + len(two) - both) if both else 0


@pytest.mark.parametrize("common", [0, 30])
def test_pairs_that_no_leader_met(spark, common):
    """Hundreds of unlike sets in one key, which end the rounds, hide a few similar pairs; each is found."""
    r = random.Random(common)
    shared = [f"s{i}" for i in range(common)]
    texts = [" ".join([*shared, *(f"w{i}x{k}" for k in range(40))]) for i in range(300)]
    for i in r.sample(range(300), 12):
        words = texts[i].split()
        words[-1 - r.randrange(3)] = "other"
        texts.append(" ".join(words))
    roots, found = linked(spark, texts, [7])
    of = lambda i: {j for j in range(len(texts)) if roots[j] == roots[i]}
    for i in range(len(texts)):
        assert of(i) == {j for j in range(len(texts)) if j == i or similarity(found[i], found[j]) >= similar_sets.SIMILARITY}


def test_shared_shingles_of_all_pairs():
    """Rare and frequent shingles, repeated and empty sets."""
    r = np.random.Generator(np.random.PCG64(3))
    sets = [np.unique(r.choice(r.choice([30, 3000, 200_000]), r.integers(0, 60)).astype(np.uint64)) for _ in range(90)]
    sets += [sets[5], np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    counts = similar_sets.shared_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


@pytest.mark.parametrize("block", [1024, 40])
def test_sets_of_a_crowded_key_are_not_joined_pair_by_pair(spark, monkeypatch, block):
    """Copies of one text with changes of their own: most pairs share their rarest common shingles, few are similar."""
    monkeypatch.setattr(similar_sets, "BLOCK", block)
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        for k in r.sample(range(120), r.choice([4, 5, 6])):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    texts += [t.replace(t.split()[0], f"z{i}", 1) for i, t in enumerate(texts[:9])]
    found = similar_sets.shingle_sets([t.encode() for t in texts])
    members = spark.createDataFrame([(k, i, i) for i in range(len(texts)) for k in (1, 2)], "band long, set long, root long")
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(found)], "set long, shingles binary")
    unmet = similar_sets._unmet(members, held, similar_sets.SIMILARITY)
    roots = {x.node: x.root for x in simhash.components(unmet).collect()}
    assert "shingle#" not in unmet._jdf.queryExecution().optimizedPlan().toString()
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(found[i], found[j]) >= similar_sets.SIMILARITY]
    label = list(range(len(texts)))
    while True:
        was = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if was == label:
            break
    assert [roots.get(i, i) for i in range(len(texts))] == label and 9 <= len({i for p in near for i in p}) < len(texts)


def test_rest_of_near_dedup_keeps_empty_texts_apart(spark):
    rows = [(i, t) for i, t in enumerate(["", " ", None, "a", "A", "b c d e f g", "b c d e f h"])]
    kept = {x.doc_id for x in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    assert kept == {0, 3, 5, 6}
