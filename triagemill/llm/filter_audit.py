"""Interaction of document filters: what each order of five filters removes, part by part.

A document that fails the filters in the set f survives exactly the subsets of filters that hold none of f. Its survival
word has 32 bits, one per subset, and bit s says whether it survives subset s. The number of documents that survive each
subset is then the positional popcount of the words, taken per batch with carry-save adders: three words of equal
weight become a sum word and a carry word of twice the weight, until few words are left to count bit by bit. Counts of
a batch leave it as one row per part, and Spark adds those up. All orders and steps follow from the 32 counts of each
label, since "kept after step i" is the count of the subset of the first i filters.

Whether a text repeats is found on digests: one row per distinct text with its smallest id, combined before the shuffle,
meets the documents in a join that adaptive execution can split if one text has a third of all rows. Labels are met on
the id. Neither join moves a text.

Defined results: a null text counts as empty; it has no words, so it fails A only (and E, if a smaller id has an empty
text). A null ``lang`` is the part ''. A null id counts as larger than all others and has no labels; rows that repeat an
id with an equal text do not make each other fail E. Of several labels of an id, a 1 wins. Every part has all orders and
steps, zeros included; an empty table has no part and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int64_array, slices, text_bytes

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: Bytes of UTF-8 that do not start a code point.
CONTINUED = bytes(range(0x80, 0xC0))
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
SLICE_BYTES = 1 << 22
#: Fewer words than this are counted bit by bit.
FEW = 96

#: The survival word by the set of filters that a document fails.
WORDS = np.array(
    [sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32
)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LABELS = ("own", "good", "toxic")
COUNTS = "part string, " + ", ".join(f"{name} array<long>" for name in LABELS)
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits in the order of ``FILTERS``; ``split`` cuts at the ASCII blanks."""
    words = text.split()
    few = len(words) < MIN_WORDS
    repetitive = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    upper = len(text) - len(text.translate(None, UPPER))
    loud = 100 * upper > MAX_UPPER_PERCENT * len(text.translate(None, CONTINUED))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return few | repetitive << 1 | loud << 2 | symbols << 3


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save addition."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= FEW:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        bits = np.unpackbits(words.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts += weight * bits.sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, quality, toxic`` of each document: the filters it fails as bits, and its labels as booleans."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    seen = own.mapInArrow(_judge, "doc_id long, part string, failed int, digest binary")
    # Only a text that occurs twice or more can make a document fail.
    copies = (
        seen.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("quality"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    late = F.col("first_id").isNotNull() & ~F.coalesce(F.col("doc_id") <= F.col("first_id"), F.lit(False))
    met = seen.join(copies, "digest", "left").select(
        "doc_id", "part", F.when(late, F.col("failed") + 16).otherwise(F.col("failed")).alias("failed")
    )
    return met.join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
        "part",
        "failed",
        F.coalesce("quality", F.lit(False)).alias("quality"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def survivors(documents: DataFrame) -> DataFrame:
    """``part, own, good, toxic``: by part the number of documents that survive each subset; of all and of each label."""
    counted = documents.mapInArrow(_count, COUNTS)
    sums = [F.array(*(F.sum(F.col(name)[s]) for s in range(SUBSETS))).alias(name) for name in LABELS]
    return counted.groupBy("part").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return survivors(judged(docs, labels)).mapInArrow(_report, REPORT)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            texts = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    pa.array([failures(t) for t in texts], pa.int32()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ],
                ["doc_id", "part", "failed", "digest"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        of = parts.indices.to_numpy()
        words = WORDS[batch.column("failed").to_numpy()]
        marks = {name: batch.column(c).to_numpy(zero_copy_only=False) for name, c in (("good", "quality"), ("toxic", "toxic"))}
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(parts.dictionary) + 1))
        found: dict[str, list] = {name: [] for name in LABELS}
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            own = words[rows]
            found["own"].append(positional_counts(own))
            for name, mark in marks.items():
                found[name].append(positional_counts(own[mark[rows]]))
        yield pa.RecordBatch.from_arrays(
            [parts.dictionary, *(pa.array(found[name], pa.list_(pa.int64())) for name in LABELS)], ["part", *LABELS]
        )


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all orders and steps: the subset before the step, the subset after it, and the number of its filter."""
    places = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    after = np.cumsum(1 << places, axis=1)
    return (after - (1 << places)).ravel(), after.ravel(), places.ravel()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, after, place = _steps()
    names = pa.array(np.repeat(ORDERS, len(FILTERS)))
    steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32())
    for batch in batches:
        for row in batch.to_pylist():
            own, good, toxic = (np.array(row[name], np.int64) for name in LABELS)
            removed = own[before] - own[after]
            failed = own[0] - own[1 << place]
            alone = own[ALL ^ (1 << place)] - own[ALL]
            summed = np.bincount(place, removed, len(FILTERS)).astype(np.int64)
            columns = (
                own[after], removed, failed - removed, alone,
                good[before] - good[after], toxic[before] - toxic[after], summed[place],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(place), pa.string()), names, steps, *map(int64_array, columns)],
                [c.split()[0] for c in REPORT.split(", ")],
            )
