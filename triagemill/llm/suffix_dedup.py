"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

A sparse suffix array: suffixes start at winnowed anchors (see ``repeats``), which every string of ``LENGTH`` bytes has at
the same place, and only at those whose first ``GRAM`` bytes occur in several documents; other suffixes cannot repeat.
Splitters sampled from the anchors of some documents cut the range of leading bytes into buckets of about equal size, to
which the suffixes are dealt out. A splitter cuts between different leading bytes, so equal strings never stand on both
sides of a border. Each bucket sorts the strings that its suffixes give by multikey quicksort, eight bytes to a
character, and neighbours that are equal in full form one group, whose smallest document keeps its bytes.

The array is sparse because a dense one has an entry per byte: at 16 bytes an entry it takes ten times the disk that the
input takes.

Defined results: a null text has no bytes. A null ``doc_id`` counts as larger than any other, and rows that repeat an id
never remove each other's bytes. Other columns are not read. An empty table gives no rows. Cuts may fall inside a UTF-8
character, so what is kept is ``binary``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, text_bytes
from .repeats import PIECE_BUCKETS, Bucket, Method, Page, Units, anchor_runs, remove_repeats, removal_mask
from .word_hashes import mixed

LENGTH = 50
GRAM = 16
SAMPLE_DOCS = 1000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def byte_units(texts: list[bytes], gram: int = GRAM) -> Units:
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    # Hashes of 1, 2, 4, ... bytes from each place on, put together to the gram's length.
    power = (buffer.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    found, done, size, rest = np.zeros(len(buffer), np.uint64), 0, 1, gram
    while rest:
        if rest & 1:
            found = found * np.uint64(0x9FB21C651E98DF25) + _shift(power, done)
            done += size
        rest >>= 1
        if rest:
            power = power * np.uint64(0xBF58476D1CE4E5B9) + _shift(power, size)
            power ^= power >> np.uint64(29)
            size *= 2
    starts = np.arange(len(buffer))
    return Units(mixed(found), edge, buffer, starts, starts + 1)


def _shift(values: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return values
    out = np.zeros_like(values)
    out[:-by] = values[by:]
    return out


def leading(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first ``GRAM`` bytes from each place on, as sortable byte strings."""
    padded = np.r_[buffer, np.zeros(GRAM, np.uint8)]
    return np.ascontiguousarray(padded[at[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()


def splitters(docs: DataFrame, n: int, length: int) -> np.ndarray:
    """``n - 1`` leading byte strings that cut a sample of the suffixes into equal shares."""
    ids = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null")
    # At most SAMPLE_DOCS numbers. The sample decides how even the buckets are, not what they find.
    picked = ids.orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)
    read = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id", "left_semi")
    rows = read.mapInArrow(_leading_sample(length), "lead binary").orderBy("lead").collect()
    if not rows or n == 1:
        return np.zeros(0, f"S{GRAM}")
    leads = np.array([bytes(r.lead) for r in rows], dtype=f"S{GRAM}")
    return np.unique(leads[(np.arange(1, n) * len(leads)) // n])


def _leading_sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                units = byte_units(text_bytes(batch.column("text")))
                anchors, _, _ = anchor_runs(units, length, GRAM)
                # One of 16 of their hashes.
                anchors = anchors[units.grams[anchors] % np.uint64(16) == 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leading(units.buffer, anchors).tolist() if len(anchors) else [], pa.binary())], ["lead"]
                )

    return run


def multikey_groups(characters: list[np.ndarray]) -> np.ndarray:
    """Sort strings, given by their characters, by multikey quicksort; the rank of each among the distinct ones.

    Strings are split by one character; those that are equal in it go on to the next, all others are in place.
    """
    n = len(characters[0])
    order = np.argsort(characters[0], kind="stable")
    first = characters[0][order]
    border = np.ones(n, dtype=bool)
    border[1:] = first[1:] != first[:-1]
    for character in characters[1:]:
        open_ = np.flatnonzero(~border | ~np.r_[border[1:], True])
        if not len(open_):
            break
        part = np.cumsum(border[open_])
        rows = order[open_]
        values = character[rows]
        by = np.lexsort((values, part))
        order[open_] = rows[by]
        values, part = values[by], part[by]
        border[open_[1:]] |= (values[1:] != values[:-1]) & (part[1:] == part[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(border) - 1
    return rank


def byte_groups(bucket: Bucket) -> np.ndarray:
    """Groups of the windows of a bucket by their bytes."""
    counts = bucket.counts
    at = np.repeat(bucket.edge[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    wide = np.zeros(len(bucket.content), dtype=np.uint64)
    padded = np.r_[bucket.content, np.zeros(8, np.uint8)].astype(np.uint64)
    for i in range(8):
        wide |= padded[i : i + len(wide)] << np.uint64(8 * (7 - i))
    places = [*range(0, bucket.window - 7, 8)]
    if places[-1] + 8 < bucket.window:
        places.append(bucket.window - 8)
    return multikey_groups([wide[at + p] for p in places])


def suffix_method(bounds: np.ndarray, length: int = LENGTH) -> Method:
    def bucket(units: Units, anchors: np.ndarray, n: int) -> np.ndarray:
        return np.searchsorted(bounds, leading(units.buffer, units.starts[anchors]), side="right")

    return Method(length, GRAM, byte_units, bucket, byte_groups)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for each row of ``docs``; ``length`` is at least 24."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    method = suffix_method(splitters(docs, PIECE_BUCKETS * partitions(docs), length), length)

    def cut(page: Page, spans: list[bytes] | None) -> pa.RecordBatch:
        sizes = [len(t) for t in page.texts]
        removed, runs, kept = [], [], []
        for text, mask in zip(page.texts, removal_mask(page, spans, sizes, length)):
            removed.append(0 if mask is None else int(mask.sum()))
            runs.append(0 if mask is None else int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
            kept.append(text if mask is None else np.frombuffer(text, np.uint8)[~mask].tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(page.real_ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return remove_repeats(docs, method, cut, SCHEMA)
