"""Rows and brute-force versions for the tests of the corpus operators."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ("the quick brown fox", "lorem ipsum dolor", "der schnelle braune Fuchs", "été à la plage", "x", "naïve 東京 🙂")


def documents(spark, rows, extra=False):
    """``rows`` are (doc_id, text) or (doc_id, text, lang). Columns named like the operators' own may be added."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("row", "kept", "score", "ids", "page", "print", "shard", "spans", "n", "text_sha256", "__label"):
            df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def odd_rows():
    """Null, empty, blank, repeated and long texts, ties, repeated and null ids."""
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, "same text here"), (5, "same  text\there"), (5, "same text here"),
        (None, "same text here"), (None, None), (6, long), (7, long + " end"), (-8, "A"), (9, "é" * 3000),
    ]


def id_key(doc_id):
    return (doc_id is None, doc_id or 0)


def without_repeats(rows, window, units, join):
    """Units covered by a window that also starts in a document with a smaller id, by looking at all windows."""
    cut = [units((t or "").encode()) for _, t in rows]
    seen = {}
    for (doc_id, _), u in zip(rows, cut):
        for i in range(len(u) - window + 1):
            w = bytes(u[i : i + window]) if isinstance(u, bytes) else tuple(u[i : i + window])
            if w not in seen or id_key(doc_id) < id_key(seen[w]):
                seen[w] = doc_id
    out = []
    for (doc_id, _), u in zip(rows, cut):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            w = bytes(u[i : i + window]) if isinstance(u, bytes) else tuple(u[i : i + window])
            if id_key(seen[w]) < id_key(doc_id):
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((doc_id, len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating_rows(seed, n=60):
    """Texts that share passages of many lengths, with ids that repeat, are negative or null."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("a", "e", "ou", "é")]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        if rows and r.random() < 0.7:
            other = r.choice(rows)[1] or ""
            a = r.randint(0, len(other))
            at = r.randint(0, len(text))
            text = text[:at] + other[a : a + r.randint(0, 200)] + text[at:]
        rows.append((r.choice([i, i, i, 7, -i, None]), text))
    return rows + [(900, None), (901, ""), (902, "ab" * 200), (903, "ab" * 160), (904, "go to it " * 40), (905, rows[3][1])]
