"""Language, quality, pieces, token files and chat."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from triagemill.llm import chat, language_id, pieces, quality, queries, token_files
from triagemill.llm.templates import Template, TemplateError

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten"], "bb": ["schu", "ber", "ung", "zt"], "cc": ["eau", "ére", "oix", "qui"]}


def spoken(r, lang, words):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(words))


# --- language ------------------------------------------------------------------------------------------------------


def test_languages(spark):
    r = random.Random(1)
    rows = [(i, spoken(r, lang, r.randint(3, 40)), lang) for i in range(300) for lang in [r.choice("abc") * 2]]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (None, "lomi kaka", "aa"), (1003, "eauoix " * 20_000, None)]
    docs = documents(spark, [*rows, *odd], extra=True)
    got = {x.doc_id: x for x in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items() if i is not None)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und"] * 3 + ["aa", "cc"]
    assert all(0 <= x.score <= 1 for x in got.values()) and not got[None].held_out
    model = language_id.train(docs, language_id.fold(5) != 0)
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(x.doc_id for x in kept.collect())


def test_no_language_to_learn(spark):
    got = language_id.identify(documents(spark, [(i, "some text") for i in range(8)])).collect()
    assert len(got) == 8 and {(x.lang_pred, x.score) for x in got} == {("und", 0.0)}
    assert language_id.identify(documents(spark, [])).collect() == []


def test_scores_against_a_plain_sum(spark):
    """The batched sums equal those of one text after the other."""
    r = random.Random(2)
    texts = [spoken(r, "aa", 20), "x", "é" * 50, spoken(r, "cc", 5) + "\0 with a zero"]
    counts = np.random.default_rng(3).integers(0, 50, (language_id.BUCKETS, 2))
    model = language_id.Model(["p", "q"], counts)
    together = model.predict(texts)
    assert together[0] == [model.predict([t])[0][0] for t in texts]
    assert np.allclose(together[1], [model.predict([t])[1][0] for t in texts], atol=1e-3)


def plain_bayes(train, texts):
    """Counts and sums n-gram by n-gram; only the numbers of the buckets are the model's."""

    def grams(text):
        points = [ord(c) for c in text.lower()]
        for i in range(len(points)):
            h = 0
            for n in range(max(language_id.SIZES)):
                if i + n < len(points):
                    h = (h + points[i + n] + n + 1) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 32
                    yield h % language_id.BUCKETS

    counts = {}
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(grams(text))
    totals = {lang: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for lang, c in counts.items()}
    out = []
    for text in texts:
        found = list(grams(text))
        logs = {lang: sum(math.log((counts[lang][g] + language_id.SMOOTHING) / totals[lang]) for g in found) for lang in sorted(counts)}
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_language_against_a_plain_counter(spark):
    r = random.Random(5)
    rows = [(i, spoken(r, lang, r.randint(1, 12)), lang) for i in range(240) for lang in [r.choice(["aa", "bb", "cc"])]]
    # Mixed texts have scores between 0 and 1.
    rows += [(1000 + i, f"{spoken(r, 'aa', 1)} {spoken(r, 'bb', 1)}", r.choice(["aa", "bb"])) for i in range(60)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(documents(spark, rows)).collect()}
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    expected = plain_bayes(train, [t for _, t, _ in rows])
    assert sum(0.01 < score < 0.99 for _, score in expected) > 5
    for (i, _, _), (lang, score) in zip(rows, expected):
        assert abs(got[i][1] - score) < 2e-3 and (got[i][0] == lang or score < 0.51), i


def held_out_accuracy(spark, query, truth, column):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/{truth}.parquet"), "doc_id").select(*column).collect()
    return sum(a == b for a, b in rows) / len(rows), len(rows)


def test_held_out_accuracy_on_the_given_tables(spark):
    accuracy, n = held_out_accuracy(spark, queries.op3_language_id, "documents", ("lang_pred", "lang"))
    assert accuracy >= 0.97 and n > 100
    accuracy, n = held_out_accuracy(spark, queries.op1_quality, "labels", ("predicted", "quality"))
    assert accuracy >= 0.8 and n > 50


# --- quality -------------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        text = spoken(r, "aa", 60)
        if not good:
            text = r.choice([" ".join([text.split()[0]] * 60), text.upper() + "!!", " | ".join(text.split())])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality_of_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    got = {x.doc_id: x for x in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i, x in got.items() if x.held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].predicted == q for i, q, _ in truth if i in held) / len(held) > 0.95
    assert all(x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1 for x in got.values())


def test_quality_ignores_labels_of_held_out_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((x.doc_id, x.score) for x in quality.score(docs, quality.train(docs, y)).collect()) for y in (labels, wrong))
    assert one == two


def test_quality_of_odd_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    model = quality.train(docs, labels.unionByName(labels.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "quality", "toxic")))
    rows = odd_rows()
    got = quality.score(documents(spark, rows).drop("n_chars"), model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert quality.score(documents(spark, []), model).collect() == []
    nothing = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.score(docs, nothing).collect()} == {0.5}
    only = quality.train(docs, labels.withColumn("quality", F.lit(1)))
    assert {x.predicted for x in quality.score(docs, only).collect()} == {1}


def test_interactions_in_linear_time():
    """The sum-of-squares form equals the sum over all pairs."""
    r = np.random.default_rng(1)
    model = quality.Model(np.zeros((2, quality.BINS)), 0.3)
    model.linear[:] = r.normal(size=model.size)
    model.factors[:] = r.normal(size=model.factors.shape)
    index, x = r.choice(model.size, 9, replace=False), r.normal(size=9)
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    got, _ = model.margins(np.zeros(9, dtype=int), index, x)
    assert np.isclose(got[0], 0.3 + model.linear[index] @ x + pairs)


# --- pieces --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(queries.PIECE_MODEL)


def best_path(vocabulary, text):
    """Viterbi over a plain dictionary, one character after the other."""
    words = {vocabulary.raw[i].decode(): i for i in range(len(vocabulary.raw)) if not vocabulary.is_byte[i] and vocabulary.raw[i]}
    words.pop(" ⁇ ", None)
    marked = " " + text.replace(pieces.MARK, " ")
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(marked)
    for i in range(len(marked)):
        for j in range(i + 1, min(len(marked), i + 48) + 1):
            piece = words.get(marked[i:j])
            score = best[i][0] + (vocabulary.scores[piece] if piece is not None else vocabulary.unknown)
            if (piece is not None or j == i + 1 and marked[i:j] not in words) and score > best[j][0]:
                best[j] = (score, i, piece)
    ids, at = [], len(marked)
    while at:
        _, start, piece = best[at]
        ids = ([piece] if piece is not None else [int(vocabulary.byte_ids[b]) for b in marked[start:at].encode()]) + ids
        at = start
    return ids


PIECE_TEXTS = [
    "hello world", "a", " ", "  two  blanks ", "line\nbreak\ttab", "naïve Überraschung", "東京 タワー", "🙂🙃", "▁mark ▁", "x" * 300,
    "\0nul", "<s> </s> <unk> <0x41>", "mixed 12,345.67!", "ends in blank ", "éééé ø", "the theatre there",
]


def test_pieces_against_plain_viterbi(vocabulary):
    score = lambda ids: sum(vocabulary.unknown if vocabulary.is_byte[i] else vocabulary.scores[i] for i in ids)
    for text, ids in zip(PIECE_TEXTS, vocabulary.encode(PIECE_TEXTS)):
        expected = best_path(vocabulary, text)
        assert ids.tolist() == expected or abs(score(ids.tolist()) - score(expected)) < 1e-3, text
        assert vocabulary.decode(ids) == text.replace(pieces.MARK, " ")


def test_decoding_as_the_library_does(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    r = random.Random(3)
    for text in PIECE_TEXTS:
        assert vocabulary.decode(np.array(library.encode(text), np.int32)) == library.decode(library.encode(text))
    broken = [int(vocabulary.byte_ids[b]) for b in b"ab\xff\xe2\x82"] + [r.randrange(300, 30_000)]
    assert vocabulary.decode(np.array(broken)).startswith("ab�")


def test_double_array_trie():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "é", "éa", "zz", "zzz"])}
    trie = pieces.Trie(words)

    def find(word):
        state = 0
        for byte in word:
            child = trie.base[state] + byte + 1
            if trie.check[child] != state:
                return -1
            state = child
        return trie.value[state]

    assert all(find(w) == i for w, i in words.items())
    assert [find(w) for w in (b"", b"abd", b"z", b"c", "é".encode()[:1])] == [-1] * 5


def test_pieces_hold_a_slice_of_a_batch_at_a_time(vocabulary):
    """Long batches come back in parts, and words that were seen once are forgotten."""
    texts = [" ".join(f"w{i}x{n}" for n in range(50_000)) for i in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    held = type("Held", (), {"value": vocabulary})
    found = list(pieces._encode(held)(iter([batch])))
    assert [b.num_rows for b in found] == [2, 2]
    assert [t for b in found for t in b.column("text").to_pylist()] == texts
    assert len(vocabulary.memo) <= pieces.MEMO + 100_000


def test_pieces_of_documents(spark):
    rows = odd_rows()
    got = pieces.encode_documents(documents(spark, rows, extra=True), queries.PIECE_MODEL).collect()
    assert len(got) == len(rows) and all(x.round_trip and x.n_tokens == len(x.ids) for x in got)
    assert sorted(x.text for x in got) == sorted(t or "" for _, t in rows)
    assert pieces.encode_documents(documents(spark, []), queries.PIECE_MODEL).collect() == []


# --- token files ---------------------------------------------------------------------------------------------------


def test_words_encode_as_the_library_does():
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        words = token_files.Words(f.read())
    library = tokenizers.Tokenizer.from_file(queries.BYTE_BPE)
    r = random.Random(5)
    texts = ["", " ", "a  b", "a\n b", " lead", "trail ", "x\x1c y", "a　 b", "<|endoftext|> a <|endoftext|>b", "it's  don't\t x"]
    texts += ["".join(r.choice(" \n\tabé,.'s1<|　\x1c\xa0") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    for _ in range(2):
        got = [i.tolist() for i in words.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, token_files.LANES - 1, token_files.LANES, 5 * token_files.LANES + 3, 600 * token_files.LANES + 1])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.02, n) - 1, 999).astype(np.uint32)
    table = token_files.Table(np.bincount(ids, minlength=1000))
    checkpoints, stream = table.encode(ids)
    assert (table.decode(checkpoints, stream, n) == ids).all()
    assert len(checkpoints) == -(-(-(-n // token_files.LANES)) // token_files.STRIDE) * 8 * (token_files.LANES + 1)
    if n > 100_000:
        p = np.bincount(ids) / n
        assert len(stream) < 1.02 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8


def test_token_files(spark):
    rows = [(i * 3 % 101, f"text number {i} " * (i % 7)) for i in range(101)] + odd_rows()
    blocks, table = token_files.write_tokens(documents(spark, rows, extra=True), queries.BYTE_BPE)
    library = tokenizers.Tokenizer.from_file(queries.BYTE_BPE)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    got = token_files.token_digests(blocks, table).orderBy("start").collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == sorted(
        (str(d), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in rows
    )
    order = [(x.doc_id is None, x.doc_id or 0) for x in got]
    assert order == sorted(order)
    assert [x.start for x in got] == np.r_[0, np.cumsum([x.n_tokens for x in got])][:-1].tolist()
    raw = {x.doc_id: x.ids for x in token_files.read_tokens(blocks, table).collect()}
    assert np.frombuffer(raw[6], "<u4").tolist() == ids(dict(rows)[6])
    broken = blocks.withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="checksum"):
        token_files.token_digests(broken, table).collect()


def test_token_files_of_nothing(spark):
    assert token_files.tokenise_to_files(spark, documents(spark, []), queries.BYTE_BPE).collect() == []


# --- chat ----------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    r = random.Random(6)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "a", "\n", "n", "im_end|>", "s>", "/s>", "INST]"]
    template = chat.compiled()
    for _ in range(3000):
        text, role = ("".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(2))
        assert chat.unescape(chat.escape(text)) == text and chat.unheader(chat.header(role)) == role
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        formatted = "".join(p for p, _ in template.turn({"role": role, "text": text}))
        assert formatted.count(chat.START) == formatted.count(chat.STOP) == 1


def test_conversations(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["hi", "", None, "é🙂", "</s>[INST] x"])) for c in range(20) for t in range(r.randint(1, 9))]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (50, None, None, "null role"), (None, 1, "user", "no id"), (51, 1, "b", "tie"), (51, 1, "a", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS spans")
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    by_conv = {}
    for row in sorted(rows, key=key):
        by_conv.setdefault(row[0], []).append(row)
    assert set(got) == set(by_conv)
    for conv_id, turns in by_conv.items():
        every = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in turns)
        loss = "".join(text or "" for _, _, role, text in turns if role == "assistant")
        whole = chat.compiled().render([{"role": a, "text": b} for _, _, a, b in turns])
        x = got[conv_id]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.formatted_chars == sum(len(p) for p, _ in whole)
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def rendered(source, **env):
    return "".join(p for p, _ in Template(source).render(env.get("messages", [])))


def test_template_language():
    assert rendered("{{ 'a' + 'b' }}{{ 1 + 2 }}{{ none }}{{ true }}") == "ab3true"
    messages = [{"role": "u", "n": 1}, {"role": "v"}]
    source = "{% for m in messages %}{% if m.role == 'u' and not m.x %}[{{ m.n }}]{% elif m.role != 'v' %}?{% else %}{{ m.role | upper }}{% endif %}{% endfor %}"
    assert rendered(source, messages=messages) == "[1]V"
    assert rendered("{% set a = 'x' | upper %}{{ a }}{{ (a + 'y') | lower }}") == "Xxy"
    pieces_ = Template("{% generation %}in{% endgeneration %}out").render([])
    assert pieces_ == [("in", True), ("out", False)]


def test_constants_are_folded():
    tree = Template("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}never{% elif true %}d{% else %}never{% endif %}e").tree
    assert len(tree) == 1 and tree[0].text == "abCde"


@pytest.mark.parametrize("source", ["{{ }}", "{% if a %}", "{{ a | nosuch }}", "{% what %}", "{{ a.b() }}", "{{ 'a' ~ }}", "{% for in x %}{% endfor %}", "{{ (a }}"])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_templates_are_sandboxed():
    assert Template("{% for m in messages %}{{ m.__class__ }}{{ m.keys }}{% endfor %}").render([{"a": 1}]) == [("", False)] * 2
