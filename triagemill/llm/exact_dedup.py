"""Exact dedup by a cuckoo-filter index of text digests.

The index holds one entry per live digest: 16-bit fingerprints in cuckoo buckets, and beside each fingerprint the stored
entry itself. A digest that meets an equal fingerprint is compared with the stored digests of its two buckets, so a
false positive of the filter costs a comparison and never a document. Insertion that runs out of moves doubles the
table and rebuilds it from the stored entries; deletion clears the slot of a verified entry.

Spark deals digests out to tasks by hash. Each map task first combines its equal digests, so a text with a third of all
rows reaches its index task as one row per map task. The distinct digests of a task bound its memory.

Defined results: a null text counts as empty. Of equal texts the smallest ``doc_id`` stays, null last; rows that repeat
a ``doc_id`` with an equal text are copies of each other, and one of them stays. Columns besides ``doc_id`` and ``text``
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import WHITE, free_name, partitions, row_hash

SLOTS = 4
MOVES = 200
ENTRY = "text_sha256 string, keep_id long, keep_row long, group_size long"


class CuckooIndex:
    """Digests with their entries ``[digest, smallest key, count]``; a key is any comparable value."""

    def __init__(self, buckets: int = 1024):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.stored: list[list[list]] = [[] for _ in range(buckets)]
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") | 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> list | None:
        """The entry of ``digest``, verified against the stored digests."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            prints = self.prints[bucket]
            if mark in prints:
                for held, entry in zip(prints, self.stored[bucket]):
                    if held == mark and entry[0] == digest:
                        return entry
        return None

    def add(self, digest: bytes, key, count: int) -> None:
        """Insert, or merge with the entry of an equal digest."""
        entry = self.find(digest)
        if entry is None:
            self._insert([digest, key, count])
        else:
            entry[1] = min(entry[1], key)
            entry[2] += count

    def _insert(self, entry: list) -> None:
        left = self._place(entry)
        if left is None:
            return
        rest = [*self.entries(), left]
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(e) is None for e in rest):
                return

    def _place(self, entry: list) -> list | None:
        """Put the entry in; returns the one that found no place after all moves."""
        mark, first, second = self._places(entry[0])
        bucket = first if len(self.prints[first]) <= len(self.prints[second]) else second
        for move in range(MOVES):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.stored[bucket].append(entry)
                self.size += 1
                return None
            slot = move % SLOTS
            self.prints[bucket][slot], mark = mark, self.prints[bucket][slot]
            self.stored[bucket][slot], entry = entry, self.stored[bucket][slot]
            bucket = self._other(bucket, mark)
        return entry

    def remove(self, digest: bytes) -> bool:
        """Take a live digest out; False if it is not in."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot, entry in enumerate(self.stored[bucket]):
                if self.prints[bucket][slot] == mark and entry[0] == digest:
                    del self.prints[bucket][slot], self.stored[bucket][slot]
                    self.size -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self.stored:
            yield from bucket


def _digest(text="text"):
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " "), 256)


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text_sha256`` for each row; ``row`` tells rows apart once the table is staged."""
    return docs.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), _digest().alias("text_sha256")
    )


def build_index(digests: DataFrame) -> DataFrame:
    """One entry per distinct digest: the row that stays and the number of rows."""
    own = digests.select("text_sha256", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    own = own.withColumn("group_size", F.lit(1).cast("long"))
    combined = own.mapInArrow(_combine, ENTRY)
    return combined.repartition(partitions(digests), "text_sha256").mapInArrow(_combine, ENTRY)


def remove_digests(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests in ``gone`` (``text_sha256``); digests it does not hold are ignored."""
    marked = index.withColumn("drop", F.lit(False)).unionByName(
        gone.select("text_sha256").where("text_sha256 is not null").distinct().withColumn("drop", F.lit(True)),
        allowMissingColumns=True,
    )
    dealt = marked.repartition(partitions(index), "text_sha256").sortWithinPartitions("drop")
    return dealt.mapInArrow(_remove, ENTRY)


def merge_indexes(index: DataFrame, more: DataFrame) -> DataFrame:
    """Entries of a later batch inserted into an index; an earlier entry with a smaller id keeps its place."""
    both = index.unionByName(more)
    return both.repartition(partitions(index), "text_sha256").mapInArrow(_combine, ENTRY)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``."""
    digests = stage(text_digests(docs), "digests")
    found = digests.join(build_index(digests), "text_sha256")
    kept = F.col("row") == F.col("keep_row")
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns. Texts move once; rows of one hot text are dealt out by their ids."""
    columns = docs.columns
    sha, keep, n = (free_name(name, columns) for name in ("__sha", "__keep", "__n"))
    # Keys without nulls let the window read the join's exchange.
    index = build_index(text_digests(docs)).select(
        F.col("text_sha256").alias(sha), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(keep)
    )
    own = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    marked = docs.withColumn(sha, _digest()).withColumn(keep, own)
    repeats = Window.partitionBy(sha, keep).orderBy(row_hash(docs))
    kept = marked.join(index, [sha, keep], "left_semi").withColumn(n, F.row_number().over(repeats))
    return kept.where(F.col(n) == 1).select(*columns)


def _key(doc_id: int | None, row: int) -> tuple:
    return (doc_id is None, doc_id or 0, row)


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.entries())
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([e[0].hex() for e in part], pa.string()),
                pa.array([None if e[1][0] else e[1][1] for e in part], pa.int64()),
                pa.array([e[1][2] for e in part], pa.int64()),
                pa.array([e[2] for e in part], pa.int64()),
            ],
            ["text_sha256", "keep_id", "keep_row", "group_size"],
        )


def _rows(batch: pa.RecordBatch) -> Iterable[tuple]:
    names = ("text_sha256", "keep_id", "keep_row", "group_size")
    return zip(*(batch.column(n).to_pylist() for n in names))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, doc_id, row, count in _rows(batch):
            index.add(bytes.fromhex(digest), _key(doc_id, row), count)
    yield from _emit(index)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for (digest, doc_id, row, count), drop in zip(_rows(batch), batch.column("drop").to_pylist()):
            if drop:
                index.remove(bytes.fromhex(digest))
            else:
                index.add(bytes.fromhex(digest), _key(doc_id, row), count)
    yield from _emit(index)
