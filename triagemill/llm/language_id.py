"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample: for each language the ``PER_LANG`` training documents with the smallest
hash of their id. Counts are summed by Spark; the driver receives at most ``BUCKETS`` numbers per language and broadcasts
the matrix of log probabilities, whose size ``MOST_LANGS`` bounds. Scoring is a map over the documents: each batch of
texts becomes one array of code points, whose n-gram hashes pick rows of the matrix that are summed by document.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if there was nothing to
learn from. Rows without an id are neither learned from nor held out. Priors are equal, so a rare language is not
held against a text. Ties go to the first language in alphabetical order. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

SIZES = (1, 2, 3)
BUCKETS = 1 << 16
PER_LANG = 1500
MOST_LANGS = 500
SMOOTHING = 0.5
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
FOLDS = 5


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _part(key: Column) -> Column:
    """A number from 0 to 1 by the hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)


class Model:
    """Languages and the log probability of each bucket in each; the last row is for n-grams that do not count."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.weights = np.zeros((BUCKETS + 1, len(langs)), dtype=np.float32)
        self.weights[:-1] = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if langs else 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not rows or not self.langs:
            return names, scores
        points, starts = code_points([texts[i] for i in rows])
        total = np.zeros((len(rows), len(self.langs)))
        for hashed in buckets(points):
            total += np.add.reduceat(self.weights[hashed], starts, axis=0)
        total -= total.max(axis=1, keepdims=True)
        odds = np.exp(total)
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        for k, i in enumerate(rows):
            names[i], scores[i] = self.langs[best[k]], float(odds[k, best[k]])
        return names, scores


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each followed by 0, and where each text starts."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    return points, np.cumsum(sizes) - sizes


def buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram size the bucket that starts at each point; ``BUCKETS`` for n-grams that hold a 0 or overrun."""
    wide = points.astype(np.uint64)
    ends = points == 0
    hashed, skip = np.zeros(len(wide), np.uint64), np.zeros(len(wide), bool)
    for n in range(max(SIZES)):
        # A part of the hash of the n-gram that starts at each point.
        shifted = np.zeros(len(wide), np.uint64)
        shifted[: len(wide) - n] = wide[n:]
        hashed = (hashed + shifted + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
        skip[: len(wide) - n] |= ends[n:]
        skip[len(wide) - n :] = True
        if n + 1 in SIZES:
            found = (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)
            found[skip] = BUCKETS
            yield found


def train(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Model:
    """A model from rows of ``docs`` (``doc_id, text, lang``) for which ``learn`` holds."""
    usable = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages; the matrix is bounded for them")
    # Hashes below a limit that about twice the wanted rows of a language pass: few rows reach the window.
    limits = [x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, (2 * per_lang + 200) / r["count"])))]
    usable = usable.where(_part(F.col("doc_id")) < F.create_map(*limits)[F.col("lang")]) if limits else usable
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = usable.select("doc_id", "lang").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang)
    # At most per_lang ids of each language.
    sample = usable.join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    for r in rows:
        counts[r.bucket, place[r.lang]] += r.n
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (at least ``doc_id, text``) as ``doc_id, held_out, lang_pred, score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(fold(FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(held, False), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose text has a language, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(held, True), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on all folds but 0, predict every row."""
    return predict(docs, train(docs, fold(FOLDS) != 0))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text and any(map(str.isalpha, text)):
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            total = counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
            for text in texts:
                for hashed in buckets(code_points([text])[0]):
                    total += np.bincount(hashed, minlength=BUCKETS + 1)
    for lang, total in counts.items():
        used = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
            ["lang", "bucket", "n"],
        )


def _score(held, keep: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                names, scores = model.predict(batch.column("text").to_pylist())
                if keep:
                    yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores)],
                        ["doc_id", "held_out", "lang_pred", "score"],
                    )

    return score
