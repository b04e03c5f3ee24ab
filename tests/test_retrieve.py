import math
import random
import re
from collections import Counter

import pytest

from triagemill.functions import fixed_values as V
from triagemill.operators import retrieve
from triagemill.plans.staging import stage
from triagemill.sources import bundled


def words(text):
    return [w.lower() for w in re.findall(r"[a-zA-Z][a-zA-Z0-9_.-]{1,}", text) if w.lower() not in V.STOP_WORDS]


def plain_ranking(corpus, text, k, least=0.0):
    """TF-IDF by the textbook: dense over the vocabulary."""
    docs = [Counter(words(f"{name} {body}")) for name, body in corpus]
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(counts):
        top = max(counts.values(), default=1)
        raw = {t: (0.5 + 0.5 * n / top) * idf[t] for t, n in counts.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    query = vector(Counter(words(text)))
    scores = [(sum(w * v.get(t, 0) for t, w in query.items()), i) for i, v in enumerate(map(vector, docs))]
    best = sorted(((round(s, 9), i) for s, i in scores if s > least), key=lambda p: (-p[0], p[1]))[:k]
    return [(i, pytest.approx(s, abs=1e-8)) for s, i in best]


@pytest.fixture
def rank(spark):
    def run(corpus, texts, k=3, least=0.0, staged=False):
        docs = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(corpus)], "ord int, name string, text string")
        queries = spark.createDataFrame(list(enumerate(texts)), "alert_id long, text string")
        index = stage(retrieve.retrieval_index(docs), "index") if staged else None
        rows = retrieve.top_techniques(queries, docs, k, least, index=index).orderBy("alert_id", "rank").collect()
        result = {i: [] for i in range(len(texts))}
        for r in rows:
            assert r["rank"] == len(result[r.alert_id]) + 1
            result[r.alert_id].append((r.ord, r.score))
        return result

    return run


@pytest.mark.parametrize("seed, staged", [(1, False), (2, True), (3, False)])
def test_random_texts_against_the_textbook(rank, seed, staged):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma.x", "delta-", "the", "of", "E1", "zeta_9", "eta", "q", "9x", "Theta", "iota."]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))

    corpus = [(text(3), text(12)) for _ in range(9)]
    corpus.append(corpus[0])
    texts = [text(25) for _ in range(40)] + ["", "the of", "unknown words only"]
    found = rank(corpus, texts, 4, 0.05, staged)
    for i, t in enumerate(texts):
        assert found[i] == plain_ranking(corpus, t, 4, 0.05), t


def test_term_counts(spark):
    docs = spark.createDataFrame([(1, "Beta alpha beta. BETA the x yy"), (2, ""), (3, None)], "id long, text string")
    rows = retrieve.term_counts(docs, "id", docs.text).collect()
    assert {(r.id, r.term, r.n, r.max_n) for r in rows} == {
        (1, "beta", 2, 2), (1, "beta.", 1, 2), (1, "alpha", 1, 2), (1, "yy", 1, 2),
    }


@pytest.fixture
def techniques(spark):
    def run(text, k=3):
        queries = spark.createDataFrame([(1, text)], "alert_id long, text string")
        corpus = bundled.techniques(spark)
        ranked = retrieve.top_techniques(queries, corpus, k)
        return retrieve.matched_techniques(ranked, corpus).orderBy("rank").collect()

    return run


def test_bundled_techniques(techniques):
    assert "T1059" in [r.id for r in techniques("encoded PowerShell scripts ran commands through the interpreter")]
    assert "T1486" in [r.id for r in techniques("ransomware left files encrypted and a note asking for payment")]
    assert len(techniques("malicious link in a phishing email opened by a user", 2)) == 2
    assert all(r.score < 0.2 for r in techniques("Cakes and cookies will be sold at the school fair on Sunday"))


def test_a_task_sums_up_a_bounded_number_of_pairs(spark, monkeypatch):
    """Queries are dealt out by their number and that of the passages; neither pairs nor sums are shuffled again."""
    passages = spark.createDataFrame([(i, "p", f"common word{i} word{i % 7}") for i in range(20)], "ord int, name string, text string")
    texts = [(i, f"common word{i % 30} unheard{i}") for i in range(100)] + [(100, None), (7, "word3"), (None, "common")]
    queries = spark.createDataFrame(texts, "alert_id long, text string")
    index = stage(retrieve.retrieval_index(passages), "index")

    def best():
        found = retrieve.top_techniques(queries, passages, index=index)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        return sorted(((-1 if r.alert_id is None else r.alert_id, r["rank"], r.ord, round(r.score, 9)) for r in rows)), plan

    whole, _ = best()
    monkeypatch.setattr(retrieve, "PAIRS_PER_TASK", 50)
    dealt, plan = best()
    assert dealt == whole and len({r[0] for r in whole}) == 101
    shuffles = re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan)
    assert shuffles and {n for keys, n in shuffles if "alert_id" in keys} == {str(-(-103 * 20 // 50))}
    assert not any("alert_id" in keys and "ord" in keys for keys, _ in shuffles)
