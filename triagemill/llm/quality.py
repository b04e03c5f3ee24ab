"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its hashed words with their shares (of length one), one bin for each structure
statistic, and one bin for what its metadata say of its length. The score adds a linear term and all pairwise
interactions of rank ``RANK``, in time linear in the entries: half of (sum of v x) squared minus the sum of squares.

It is fitted on the driver by Adagrad on at most ``SAMPLE`` labelled documents, those with the smallest hashes of their
ids; their vectors, not their texts, reach the driver. Bin edges are quantiles of the sample. The model's size depends
on parameters only; it is broadcast, and scoring is a map over whole texts.

Defined results: null texts score as empty ones. ``n_chars`` may be null or missing. Labels that are null or whose id
is null are not used; with nothing to learn from, or one class only, every score is the share of label 1 (one half if
there is none). Repeated labels of an id all count, and rows of ``docs`` that repeat an id each have a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, text_bytes
from .word_hashes import WHITE, hashes, joined, mixed, runs

BUCKETS = 1 << 15
SAMPLE = 8000
BINS = 12
RANK = 8
EPOCHS = 8
BATCH = 256
RATE = 0.08
SHRINK = 2e-4
SLICE_BYTES = 2 << 20
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SCORES = "doc_id long, held_out boolean, score double, predicted int"

_UPPER, _DIGIT, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
STATISTICS = (
    "log words", "log bytes", "mean word length", "upper share", "digit share", "mark share", "white share",
    "distinct words", "most frequent word", "repeated neighbours", "distinct pairs", "mark at word end", "lone marks",
    "words a line", "distinct lines", "comma and stop share",
)


def features(texts: list[bytes], stated: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry counts, word buckets and shares of each text, and a matrix of statistics."""
    n = len(texts)
    buffer, edge = joined(texts)
    sizes = np.diff(edge) - 1
    starts, stops = runs(~WHITE[buffer])
    doc = np.searchsorted(edge, starts, side="right") - 1
    lower = np.frombuffer(LOWER, np.uint8)[buffer]
    word = hashes(lower, starts, stops)
    words = np.bincount(doc, minlength=n)
    bucket = (word & np.uint64(BUCKETS - 1)).astype(np.int64)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    of, bucket = key // BUCKETS, key % BUCKETS
    entries = np.bincount(of, minlength=n)
    norm = np.sqrt(np.bincount(of, weights=count.astype(float) ** 2, minlength=n))
    shares = count / norm[of]

    def share(inside: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(inside)]
        return (sums[edge[1:] - 1] - sums[edge[:-1]]) / np.maximum(1, sizes)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n) / np.maximum(1, words)

    most = np.zeros(n)
    np.maximum.at(most, of, count)
    same_doc = doc[1:] == doc[:-1]
    twice = np.bincount(doc[1:][same_doc & (word[1:] == word[:-1])], minlength=n)
    pair_doc = doc[1:][same_doc]
    pair = mixed(word[1:] * np.uint64(3) + word[:-1])[same_doc] >> np.uint64(20)
    pairs = np.bincount(_distinct_docs(pair_doc, pair), minlength=n)
    line_starts, line_stops = runs(buffer != 10)
    line_doc = np.searchsorted(edge, line_starts, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    line = hashes(buffer, line_starts, line_stops)
    distinct_lines = np.bincount(_distinct_docs(line_doc, line), minlength=n)
    last = buffer[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    plain = (last == 44) | (last == 46)
    length = np.array([-1 if s is None else s for s in stated], dtype=float)
    chars = np.diff(np.r_[0, np.cumsum((buffer & 0xC0) != 0x80)][edge]) - 1
    ratio = np.log2((np.maximum(length, 0) + 1) / (np.maximum(chars, 0) + 1))
    told = np.where(length < 0, 0.0, 1 + np.clip(np.round(8 * ratio), -40, 40) / 100)
    return (
        entries,
        bucket,
        shares,
        np.stack(
            [
                np.log1p(words),
                np.log1p(sizes),
                per_word((stops - starts).astype(float)),
                share(_UPPER[buffer]),
                share(_DIGIT[buffer]),
                share(_MARK[buffer]),
                share(WHITE[buffer]),
                np.bincount(of, minlength=n) / np.maximum(1, words),
                most / np.maximum(1, words),
                twice / np.maximum(1, words),
                pairs / np.maximum(1, words - 1),
                per_word((_MARK[last] & ~plain).astype(float)),
                per_word((_MARK[last] & (stops - starts == 1)).astype(float)),
                words / np.maximum(1, lines),
                distinct_lines / np.maximum(1, lines),
                per_word(plain.astype(float)),
                told,
            ],
            axis=1,
        ),
    )


def _distinct_docs(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The documents of the distinct pairs of a document and a value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh]


class Model:
    """A fitted machine; ``edges`` are the bin borders of each statistic."""

    def __init__(self, edges: np.ndarray, base: float):
        self.edges = edges
        self.size = BUCKETS + edges.shape[0] * (BINS + 1)
        self.base = base
        self.linear = np.zeros(self.size)
        self.factors = np.random.Generator(np.random.PCG64(7)).normal(0, 0.02, (self.size, RANK))

    def vectors(self, entries, bucket, shares, statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, index and value of every entry, sorted by row; each row has its bins, so none is empty."""
        n, kinds = statistics.shape
        bins = np.stack([np.searchsorted(e, statistics[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)
        index = BUCKETS + np.arange(kinds) * (BINS + 1) + bins
        rows = np.r_[np.repeat(np.arange(n), entries), np.repeat(np.arange(n), kinds)]
        order = np.argsort(rows, kind="stable")
        values = np.r_[shares, np.full(n * kinds, 1 / np.sqrt(kinds))]
        return rows[order], np.r_[bucket, index.ravel()][order], values[order]

    def margins(self, rows: np.ndarray, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds, and the sums of v x, of rows numbered from 0 without gaps."""
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        vx = self.factors[index] * values[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat(vx * vx, first, axis=0)
        out = self.base + np.add.reduceat(self.linear[index] * values, first)
        return out + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, found) -> np.ndarray:
        if not len(found[3]):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.vectors(*found))[0], -500, 500)))

    def fit(self, rows: np.ndarray, index: np.ndarray, values: np.ndarray, labels: np.ndarray) -> None:
        first = np.r_[np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]), len(rows)]
        random = np.random.Generator(np.random.PCG64(11))
        seen_linear, seen_factors = np.full(self.size, 1e-2), np.full((self.size, RANK), 1e-2)
        for _ in range(EPOCHS):
            order = random.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
                own = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
                idx, x = index[pick], values[pick]
                margin, sums = self.margins(own, idx, x)
                wrong = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[batch]
                g = wrong[own] * x
                used, place = np.unique(idx, return_inverse=True)
                slope = np.bincount(place, weights=g) + SHRINK * self.linear[used]
                seen_linear[used] += slope**2
                self.linear[used] -= RATE * slope / np.sqrt(seen_linear[used])
                pull = g[:, None] * (sums[own] - self.factors[idx] * x[:, None])
                slope = np.stack([np.bincount(place, weights=pull[:, k]) for k in range(RANK)], axis=1)
                slope += SHRINK * self.factors[used]
                seen_factors[used] += slope**2
                self.factors[used] -= RATE * slope / np.sqrt(seen_factors[used])
                self.base -= RATE * wrong.mean()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality`` (0 or 1) from at most ``sample`` labelled rows of the training folds."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("__label"))
    usable = usable.where(F.col("__label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    # At most ``sample`` pairs of numbers, so the texts stay where they are.
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(sample)
    read = docs.select(F.col("doc_id").cast("long"), "text", _stated(docs)).join(F.broadcast(picked), "doc_id")
    got = read.select("doc_id", "text", "n_chars", "__label").mapInArrow(
        _featurize, "doc_id long, label int, buckets binary, shares binary, statistics binary"
    )
    # Rows may repeat an id; the bound is on labels, so it is put on the rows once more.
    rows = got.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "buckets").limit(sample).collect()
    labels_ = np.array([r.label for r in rows], dtype=float)
    kinds = len(STATISTICS) + 1
    statistics = np.array([np.frombuffer(r.statistics) for r in rows]).reshape(-1, kinds)
    share = labels_.mean() if len(labels_) else 0.5
    if share in (0.0, 1.0) or not len(labels_):
        model = Model(np.zeros((kinds, BINS)), 0.0 if not len(labels_) else (40.0 if share else -40.0))
        model.factors[:] = 0
        return model
    model = Model(np.quantile(statistics, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T, float(np.log(share / (1 - share))))
    entries = np.array([len(r.buckets) // 8 for r in rows])
    bucket = np.frombuffer(b"".join(r.buckets for r in rows), np.int64)
    shares = np.frombuffer(b"".join(r.shares for r in rows), np.float64)
    model.fit(*model.vectors(entries, bucket, shares, statistics), labels_)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text", _stated(docs))
    return rows.mapInArrow(_score(held), SCORES)


def _stated(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            entries, bucket, shares, statistics = features(
                text_bytes(batch.column("text")), batch.column("n_chars").to_pylist()
            )
            cut = np.cumsum(entries)[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("__label"),
                    pa.array([b.tobytes() for b in np.split(bucket, cut)], pa.binary()),
                    pa.array([s.tobytes() for s in np.split(shares, cut)], pa.binary()),
                    pa.array([s.tobytes() for s in statistics], pa.binary()),
                ],
                ["doc_id", "label", "buckets", "shares", "statistics"],
            )


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = features(text_bytes(batch.column("text")), batch.column("n_chars").to_pylist())
                scores = model.score(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(scores),
                        pa.array((scores >= THRESHOLD).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run
