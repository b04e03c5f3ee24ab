"""Substring dedup by seed and extend: words covered by a window of ``WINDOW`` words that a smaller document has too.

Seeds are winnowed anchors of ``SEED`` words (see ``repeats``); documents are joined on the hashes of their seeds. In its
bucket each seed is verified and then extended word by word, to the left and to the right, for all documents at once: a
rank tells which of them agree so far, and one that agrees with no other any longer goes no further. A window repeats if
one of a smaller document agrees with it as far to the left and as far to the right as it reaches. Neighbouring windows
that repeat merge into maximal repeats, of which those of at least ``WINDOW`` words go.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged; a null text has none. A null ``doc_id`` counts as
larger than any other, and rows that repeat an id never remove each other's words. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Bucket, Method, Page, Units, remove_repeats, removal_mask
from .word_hashes import WHITE, hashes, mixed, runs

WINDOW = 13
SEED = 5
SCHEMA = "doc_id long, n_words long, n_removed long, kept binary"


def word_units(texts: list[bytes]) -> Units:
    """Words with one blank behind each, whatever stood between them."""
    split = [t.split() for t in texts]
    edge = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
    buffer = np.frombuffer(b"".join(b" ".join([*words, b""]) for words in split), np.uint8)
    starts, stops = runs(~WHITE[buffer])
    word = hashes(buffer, starts, stops)
    gram = np.zeros(len(word), np.uint64)
    for i in range(SEED):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: max(0, len(word) - i)] = word[i:]
        gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + shifted)
    return Units(gram, edge, buffer, starts, stops + 1)


def seed_bucket(units: Units, anchors: np.ndarray, n: int) -> np.ndarray:
    return ((units.grams[anchors] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def word_groups(bucket: Bucket) -> np.ndarray:
    """Groups of the windows of a bucket: by how many words stand before the seed, and how far both sides agree."""
    numbers: dict[bytes, int] = {}
    split = bucket.content.tobytes().split()
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in split), np.int64, len(split))
    starts, _ = runs(~WHITE[bucket.content])
    first = np.searchsorted(starts, bucket.edge)
    seed = np.searchsorted(starts, bucket.edge[:-1] + bucket.anchors)
    agree = np.zeros(len(seed), np.int64)
    for i in range(SEED):
        agree = _extended(agree, words, seed + i, seed + i < first[1:])
    left, right = [agree], [agree]
    reach = bucket.window - SEED
    for i in range(1, reach + 1):
        left.append(_extended(left[-1], words, seed - i, seed - i >= first[:-1]))
        right.append(_extended(right[-1], words, seed + SEED - 1 + i, seed + SEED - 1 + i < first[1:]))
    # Windows of piece p start at its first words; the seed stands ``before`` words behind the start.
    counts = bucket.counts
    piece = np.repeat(np.arange(len(counts)), counts)
    before = np.repeat(seed - first[:-1], counts) - (np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts))
    both = np.stack([np.stack(left)[before, piece], np.stack(right)[reach - before, piece], before])
    return _ranks(both[0] * (reach + 1) + both[2], both[1])


def _ranks(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The rank of each pair among the distinct ones."""
    order = np.lexsort((two, one))
    border = np.zeros(len(order), dtype=np.int64)
    border[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(border)
    return rank


def _extended(agree: np.ndarray, words: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Ranks after one more word. A piece without that word, or that agreed with no other before, stands alone."""
    alone = ~there | (np.bincount(agree)[agree] == 1)
    next_word = np.where(alone, -1 - np.arange(len(at)), words[np.where(there, at, 0)])
    return _ranks(agree, next_word)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs``; ``kept`` is words joined by one blank."""
    if window <= SEED:
        raise ValueError(f"window must be over {SEED}")
    method = Method(window, SEED, word_units, seed_bucket, word_groups)

    def cut(page: Page, spans: list[bytes] | None) -> pa.RecordBatch:
        split = [t.split() for t in page.texts]
        sizes = [len(w) for w in split]
        removed, kept = [], []
        for words, mask in zip(split, removal_mask(page, spans, sizes, window)):
            removed.append(0 if mask is None else int(mask.sum()))
            kept.append(b" ".join(words if mask is None else [w for w, gone in zip(words, mask.tolist()) if not gone]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(page.real_ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return remove_repeats(docs, method, cut, SCHEMA)
