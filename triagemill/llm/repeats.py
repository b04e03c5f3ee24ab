"""What the two substring operators share: pages of texts, winnowed anchors, and the way of repeats back to their page.

A window is a run of a fixed number of units (bytes or words) of one document; a repeat is a window that also starts in a
document with a smaller id. Texts are packed into pages; one shuffle deals the pages out, and each pass below reads that
same exchange again.

1. Copies: documents equal as a whole to one with a smaller id are marked by their digests. Each of their windows is a
   repeat, so they take no further part.
2. Winnowing: the anchor of a window is the leftmost unit in it with the smallest hash of the ``gram`` units from there
   on. Equal windows have equal anchors at equal places. Every page sends the hashes of its anchors, each once, to the
   hash's bucket, and learns which of them occur in more than one document.
3. Pieces: for each such anchor the page sends the stretch of text that the anchor's windows cover, with document and
   place. Of equal stretches within a page only those of its smallest document travel, the others are repeats already;
   so a passage in a third of all documents reaches its bucket once per page.
4. A bucket compares the windows of its pieces by their contents and returns spans to the pages.
5. Each page cuts its documents.

Hashes only choose anchors and filter; what is removed was compared byte by byte. Steps 2 to 4 are exact for every window
whatever the texts are: nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, text_bytes
from .word_hashes import mixed

PAGE_BYTES = 1 << 19
#: Units handled at once; a longer document is handled in overlapping parts.
PART = 1 << 17
#: Buckets of pieces for each partition: a task holds one bucket at a time, and several even out.
PIECE_BUCKETS = 4
PLACE = np.uint64((1 << 24) - 1)
LAST = np.iinfo(np.int64).max
PAGES = "page long, doc_ids array<long>, sizes binary, payload binary"
PIECES = (
    "bucket int, page long, doc_ids binary, places binary, starts binary, counts binary, anchors binary, sizes binary, "
    "content binary, spans binary"
)


@dataclass
class Units:
    """Units of the documents of a part: a hash of the gram from each unit on, and the bytes each unit takes."""

    grams: np.ndarray
    edge: np.ndarray  # units before each document, and their total
    buffer: np.ndarray
    starts: np.ndarray  # first byte of each unit
    stops: np.ndarray  # byte behind each unit


@dataclass
class Method:
    """How an operator cuts texts into units, deals pieces out, and compares windows."""

    window: int
    gram: int
    units: Callable[[list[bytes]], Units]
    bucket: Callable[[Units, np.ndarray, int], np.ndarray]
    #: Group number of each window of the pieces in a bucket; equal contents, and only they, have equal numbers.
    groups: Callable[["Bucket"], np.ndarray]


@dataclass
class Bucket:
    """Pieces that met in a bucket, sorted so that windows of one anchor are near each other."""

    window: int
    content: np.ndarray
    edge: np.ndarray  # bytes before each piece
    counts: np.ndarray  # windows of each piece
    anchors: np.ndarray  # bytes of each piece before its anchor


def least_hash(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` grams the place of the leftmost of those with the smallest upper 40 bits."""
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key & PLACE).astype(np.int64)


def anchor_runs(units: Units, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, each with the first of its windows and the number of them."""
    total = int(units.edge[-1])
    if total < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    anchor = least_hash(units.grams[: total - gram + 1], window - gram + 1)
    valid = np.ones(len(anchor), dtype=bool)
    for start, stop in zip(units.edge[:-1].tolist(), units.edge[1:].tolist()):
        valid[max(start, stop - window + 1) : stop] = False
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    counts = np.add.reduceat(valid, first, dtype=np.int64) if len(first) else first
    return anchor[first], first, counts


class Page:
    """Documents of a page and its parts, cut into units."""

    def __init__(self, row: dict, method: Method):
        self.page = row["page"]
        self.doc_ids = np.array([LAST if d is None else d for d in row["doc_ids"]], dtype=np.int64)
        self.real_ids = row["doc_ids"]
        sizes = np.frombuffer(row["sizes"], "<i8")
        raw = zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=int(sizes.sum()) + 1)[:-1]
        ends = np.cumsum(sizes)
        self.texts = [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]
        self.copies = set(row.get("copies") or ())
        self.method = method

    def parts(self) -> Iterator[tuple[np.ndarray, Units, np.ndarray]]:
        """Documents of each part, their units, and for each document the unit of the text it starts with."""
        held, texts, size = [], [], 0
        for i, text in enumerate(self.texts):
            if i in self.copies or len(text) < self.method.window:
                continue
            if held and size + len(text) > PART:
                yield from self._cut(held, texts)
                held, texts, size = [], [], 0
            held.append(i)
            texts.append(text)
            size += len(text)
        if held:
            yield from self._cut(held, texts)

    def _cut(self, held: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, Units, np.ndarray]]:
        units = self.method.units(texts)
        total, overlap = int(units.edge[-1]), self.method.window - 1
        if total <= 4 * PART:
            yield np.array(held), units, np.zeros(len(held), np.int64)
            return
        # One long document: windows that start in each stretch, with the units they reach into.
        for at in range(0, max(1, total - overlap), 2 * PART):
            stop = min(total, at + 2 * PART + overlap)
            part = Units(
                units.grams[at:stop], np.array([0, stop - at]), units.buffer, units.starts[at:stop], units.stops[at:stop]
            )
            yield np.array(held), part, np.array([at])


def make_pages(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` in pages, dealt out evenly; every pass reads this exchange."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pages, PAGES)
    return rows.repartition(partitions(docs), "page")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    pack = zstandard.ZstdCompressor(1)
    ids: list = []
    texts: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.binary()),
                pa.array([pack.compress(b"".join(texts) + b"\0")], pa.binary()),
            ],
            ["page", "doc_ids", "sizes", "payload"],
        )

    for whole in batches:
        for batch in slices(whole, "text", PAGE_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                if texts and size + len(text) > PAGE_BYTES:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
    if texts:
        yield flush()


def _each(batches: Iterator[pa.RecordBatch], method: Method) -> Iterator[tuple[Page, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield Page(row, method), row


def with_copies(pages: DataFrame, method: Method) -> DataFrame:
    """``pages`` with ``copies``, the places of documents whose whole text a smaller id has."""
    digests = pages.mapInArrow(_digests(method), "page long, place int, id long, high long, low long")
    first = digests.groupBy("high", "low").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(first.drop("n"), ["high", "low"]).where("least < id")
    return pages.join(copies.groupBy("page").agg(F.collect_list("place").alias("copies")), "page", "left")


def _digests(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, _ in _each(batches, method):
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in page.texts), ">i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(both), page.page)),
                    pa.array(np.arange(len(both), dtype=np.int32)),
                    pa.array(page.doc_ids),
                    pa.array(both[:, 0].astype(np.int64)),
                    pa.array(both[:, 1].astype(np.int64)),
                ],
                ["page", "place", "id", "high", "low"],
            )

    return run


def with_shared(pages: DataFrame, method: Method) -> DataFrame:
    """``pages`` with ``shared``, sorted hashes of their anchors that occur in several documents, by bucket."""
    n = partitions(pages)
    sent = pages.mapInArrow(_winnow(method, n), "bucket int, page long, grams binary")
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "page long, grams binary")
    return pages.join(met.groupBy("page").agg(F.collect_list("grams").alias("shared")), "page", "left")


def _winnow(method: Method, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, _ in _each(batches, method):
            grams, docs = [], []
            for held, units, _ in page.parts():
                anchor, first, _ = anchor_runs(units, method.window, method.gram)
                grams.append(units.grams[anchor])
                docs.append(page.doc_ids[held][np.searchsorted(units.edge, first, side="right") - 1])
            if not grams:
                continue
            gram, doc = np.concatenate(grams), np.concatenate(docs)
            order = np.argsort(gram, kind="stable")
            gram, doc = gram[order], doc[order]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
            if not len(first):
                continue
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            # The lowest bit tells whether several documents of the page have the anchor.
            gram = gram[first] & ~np.uint64(1) | several.astype(np.uint64)
            yield from _dealt(page.page, gram, ((gram >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64))

    return run


def _dealt(page: int, gram: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a page; ``bucket`` rises with ``gram``, which is sorted."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    parts = np.split(gram, cuts[1:])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts].astype(np.int32)),
            pa.array(np.full(len(cuts), page)),
            pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary()),
        ],
        ["bucket", "page", "grams"],
    )


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each bucket; they come sorted by it. Of a batch only the rows of one bucket become Python values at once."""
    held: list[dict] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            rows = batch.slice(a, b - a).to_pylist()
            if held and rows and held[0]["bucket"] != rows[0]["bucket"]:
                yield held
                held = []
            held += rows
    if held:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches):
        grams = [np.frombuffer(r["grams"], "<u8") for r in rows]
        flat = np.concatenate(grams)
        key = flat >> np.uint64(1)
        order = np.argsort(key, kind="stable")
        key, several = key[order], (flat[order] & np.uint64(1)).astype(bool)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        wanted = np.zeros(len(flat), dtype=bool)
        wanted[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(several, first), sizes)
        pages, found = [], []
        for r, g, w in zip(rows, grams, np.split(wanted, np.cumsum([len(g) for g in grams])[:-1])):
            if w.any():
                pages.append(r["page"])
                found.append((g[w] | np.uint64(1)).astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(found, pa.binary())], ["page", "grams"])


def with_spans(pages: DataFrame, method: Method) -> DataFrame:
    """``pages`` with ``spans``: packed ``(place of the document, first unit, unit behind)`` that are repeats."""
    n = partitions(pages)
    sent = pages.mapInArrow(_pieces(method, PIECE_BUCKETS * n), PIECES)
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _compare(method), "page long, spans binary"
    )
    return met.groupBy("page").agg(F.collect_list("spans").alias("spans"))


def _pieces(method: Method, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, row in _each(batches, method):
            if not row["shared"]:
                continue
            shared = np.sort(np.frombuffer(b"".join(row["shared"]), "<u8"))
            found = [p for part in page.parts() if (p := _part_pieces(page, method, shared, n, *part)) is not None]
            if found:
                yield from _sent(page, method, found)

    return run


def _part_pieces(page: Page, method: Method, shared: np.ndarray, n: int, held, units: Units, base) -> dict | None:
    anchor, first, count = anchor_runs(units, method.window, method.gram)
    gram = units.grams[anchor] | np.uint64(1)
    at = np.minimum(np.searchsorted(shared, gram), len(shared) - 1)
    hit = shared[at] == gram
    if not hit.any():
        return None
    anchor, first, count = anchor[hit], first[hit], count[hit]
    start, stop = units.starts[first], units.stops[first + count - 1 + method.window - 1]
    doc = np.searchsorted(units.edge, first, side="right") - 1
    return {
        "place": held[doc],
        "first": first - units.edge[doc] + base[doc],
        "count": count,
        "anchor": units.starts[anchor] - start,
        "bucket": method.bucket(units, anchor, n),
        "text": [units.buffer[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist())],
    }


def _sent(page: Page, method: Method, parts: list[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces by bucket, and one row of the spans that are repeats within the page."""
    place, first, count, anchor, bucket = (
        np.concatenate([p[c] for p in parts]) for c in ("place", "first", "count", "anchor", "bucket")
    )
    texts = [t for p in parts for t in p["text"]]
    ids = page.doc_ids[place]
    # Equal stretches by their bytes.
    numbers: dict[bytes, int] = {}
    group = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
    least = np.full(len(numbers), LAST)
    np.minimum.at(least, group, ids)
    local = ids > least[group]
    rows = []
    if local.any():
        spans = np.stack([place[local], first[local], first[local] + count[local] + method.window - 1], axis=1)
        rows.append((-1 - page.page % 1_000_003, *[None] * 7, spans.astype("<i8").tobytes()))
    send = np.flatnonzero(~local)
    send = send[np.argsort(bucket[send], kind="stable")]
    pack = zstandard.ZstdCompressor(1)
    cuts = np.flatnonzero(np.r_[True, bucket[send][1:] != bucket[send][:-1]]) if len(send) else []
    for part in np.split(send, cuts[1:]) if len(send) else ():
        content = [texts[i] for i in part.tolist()]
        arrays = (ids[part], place[part], first[part])
        small = (count[part], anchor[part], np.fromiter(map(len, content), np.int64, len(content)))
        rows.append(
            (
                int(bucket[part[0]]),
                *(a.astype("<i8").tobytes() for a in arrays),
                *(a.astype("<i4").tobytes() for a in small),
                pack.compress(b"".join(content)),
                None,
            )
        )
    columns = list(zip(*rows))
    names = ("doc_ids", "places", "starts", "counts", "anchors", "sizes", "content", "spans")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int32()),
            pa.array(np.full(len(rows), page.page)),
            *(pa.array(c, pa.binary()) for c in columns[1:]),
        ],
        ["bucket", "page", *names],
    )


#: Windows compared at once in a bucket; its pieces are taken in groups by anchor, which no window crosses.
WINDOWS = 100_000


def _compare(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            if rows[0]["bucket"] < 0:
                yield _span_rows([(r["page"], r["spans"]) for r in rows])
            else:
                yield _span_rows(_bucket_spans(method, rows))

    return run


def _span_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["page", "spans"]
    )


def _bucket_spans(method: Method, rows: list[dict]) -> list[tuple[int, bytes]]:
    unpack = zstandard.ZstdDecompressor()
    read = {c: np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("doc_ids", "places", "starts")}
    read |= {c: np.concatenate([np.frombuffer(r[c], "<i4") for r in rows]).astype(np.int64) for c in ("counts", "anchors", "sizes")}
    content = np.frombuffer(b"".join(unpack.decompress(r["content"]) for r in rows), np.uint8)
    source = np.repeat(np.arange(len(rows)), [len(r["sizes"]) // 4 for r in rows])
    edge = np.r_[0, np.cumsum(read["sizes"])]
    # Anchors by the first eight bytes of their gram: pieces of one anchor stay together.
    lead = _leads(content, edge[:-1] + read["anchors"])
    parts = max(1, -(-int(read["counts"].sum()) // WINDOWS))
    part = (mixed(lead) % np.uint64(parts)).astype(np.int64)
    out: dict[int, list[np.ndarray]] = {}
    for k in range(parts):
        own = np.flatnonzero(part == k)
        if not len(own):
            continue
        sizes, counts = read["sizes"][own], read["counts"][own]
        own_edge = np.r_[0, np.cumsum(sizes)]
        take = np.repeat(edge[own] - own_edge[:-1], sizes)
        take += np.arange(own_edge[-1])
        group = method.groups(Bucket(method.window, content[take], own_edge, counts, read["anchors"][own]))
        ids = np.repeat(read["doc_ids"][own], counts)
        least = np.full(int(group.max()) + 1, LAST)
        np.minimum.at(least, group, ids)
        repeat = least[group] < ids
        if not repeat.any():
            continue
        piece = np.repeat(np.arange(len(own)), counts)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
        new = repeat.copy()
        new[1:] &= ~repeat[:-1] | (piece[1:] != piece[:-1])
        last = repeat.copy()
        last[:-1] &= ~repeat[1:] | (piece[1:] != piece[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        at = own[piece[a]]
        spans = np.stack(
            [read["places"][at], read["starts"][at] + nth[a], read["starts"][at] + nth[b] + method.window], axis=1
        )
        for row in np.unique(source[at]).tolist():
            out.setdefault(row, []).append(spans[source[at] == row])
    return [(rows[r]["page"], np.concatenate(s).astype("<i8").tobytes()) for r, s in out.items()]


def _leads(content: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; zeros stand behind the end."""
    padded = np.r_[content, np.zeros(8, np.uint8)]
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[at + i]
    return out


def removal_mask(page: Page, spans: list[bytes] | None, sizes: list[int], window: int) -> list[np.ndarray | None]:
    """For each document which of its units go; None if none does."""
    masks: list[np.ndarray | None] = [None] * len(sizes)
    for i in page.copies:
        if sizes[i] >= window:
            masks[i] = np.ones(sizes[i], dtype=bool)
    if spans:
        rows = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        for part in np.split(rows, cuts[1:]):
            i = int(part[0, 0])
            change = np.bincount(part[:, 1], minlength=sizes[i] + 1) - np.bincount(part[:, 2], minlength=sizes[i] + 1)
            masks[i] = np.cumsum(change[:-1]) > 0
    return masks


def remove_repeats(docs: DataFrame, method: Method, cut: Callable, schema: str) -> DataFrame:
    """All passes; ``cut`` turns a page and its packed spans into columns of ``schema``."""
    pages = with_copies(make_pages(docs), method)
    spans = with_spans(with_shared(pages, method), method)
    joined = pages.join(spans, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, row in _each(batches, method):
            yield cut(page, row["spans"])

    return joined.mapInArrow(run, schema)
