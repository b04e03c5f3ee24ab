"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Each is a word of the perfect binary Golay code
[23, 12, 7] (with leading zeros), which decodes to the index of the one codeword within three bits. Two segments that
differ in at most one bit share an index if each segment gives its own index, and one at distance three from its codeword
also gives those of its neighbours.

Fingerprints that differ in at most three bits differ, by the pigeonhole principle, either in no bit of some segment
and then in at most one bit of another, or in exactly one bit of each. So each fingerprint gives the keys
(exact segment, index of another segment) for all six choices, and for the second case (index of the first segment,
one exact half of each other segment), four halves. Fingerprints that share a key are compared; the links found are
verified distances.

Equal fingerprints are merged before keys are made. Within a key only links that span its clusters leave the task, so
output grows with the number of fingerprints; keys with more than ``RUN`` fingerprints are split into tiles of pairs of
blocks and dealt out again. Components are found by alternating large-star and small-star steps, each written to the
shared folder.

Defined results: a null text has no words and fingerprint zero. Rows that repeat a ``doc_id`` each have a row. A null
``doc_id`` never names a component unless all its documents have none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import similar_sets
from .common import LOWER, partitions, row_hash, slices, text_bytes

SHINGLE = 3
DISTANCE = 3
SEED = 42
RUN = 2048
SLICE_BYTES = 2 << 20
#: Bit ranges of the segments, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is set if it is in more than half of the shingles' hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _leaders() -> np.ndarray:
    """The lightest word of each of the 2048 syndromes."""
    words = [0, *(1 << i for i in range(23))]
    words += [1 << i | 1 << j for i in range(23) for j in range(i)]
    words += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    words = np.array(words, dtype=np.int64)
    out = np.zeros(2048, dtype=np.int64)
    out[_syndrome(words)] = words
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the polynomial division by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GOLAY << (bit - 11))
    return rest


LEADERS = _leaders()
WEIGHTS = np.array([bin(w).count("1") for w in LEADERS.tolist()])
FLIPS = np.r_[0, 1 << np.arange(23)].astype(np.int64)


def indices(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and a codeword index. A codeword is systematic, so its upper 12 bits are its index."""
    own = _syndrome(segments)
    near = segments[:, None] ^ FLIPS[None, :]
    decoded = (near ^ LEADERS[_syndrome(near)]) >> 11
    # Within two bits of its codeword a word and all its neighbours decode alike; one index is enough.
    decoded[WEIGHTS[own] < 3] = decoded[WEIGHTS[own] < 3, :1]
    decoded.sort(axis=1)
    first = np.ones(decoded.shape, dtype=bool)
    first[:, 1:] = decoded[:, 1:] != decoded[:, :-1]
    rows, _ = np.nonzero(first)
    return rows, decoded[first]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys (int64) of distinct fingerprints (uint64)."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    fuzzy = [indices(p) for p in parts]
    rows, keys = [], []
    for exact in range(3):
        for other in range(3):
            if exact != other:
                r, index = fuzzy[other]
                rows.append(r)
                keys.append(np.int64(exact * 3 + other) << 40 | parts[exact][r] << 12 | index)
    r, index = fuzzy[0]
    low, high = 10, 11
    for kind in range(4):
        b, c = parts[1][r], parts[2][r]
        b = b & ((1 << low) - 1) if kind & 1 else b >> low
        c = c & ((1 << low) - 1) if kind & 2 else c >> low
        rows.append(r)
        keys.append(np.int64(9 + kind) << 40 | index << (2 * high) | b << high | c)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` for each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, print long")


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: verified links that connect all distinct ``print`` values within the distance."""
    n = partitions(prints)
    keyed = prints.select("print").mapInArrow(_keys, "key long, print long")
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "print")
    found = dealt.mapInArrow(_compare, "a long, b long, key long, place int, blocks int")
    found = stage(found, "links")
    large = found.where("key is not null").select("key", "place", "blocks", F.col("a").alias("print"))
    sides = F.expr(
        "flatten(transform(sequence(0, blocks - 1), o -> "
        "if(o = place, array(struct(place as i, place as j)), "
        "array(struct(least(place, o) as i, greatest(place, o) as j)))))"
    )
    tiles = large.select("key", "print", "place", F.explode(sides).alias("t")).select("key", "t.*", "place", "print")
    tiles = tiles.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "place", "print")
    more = tiles.mapInArrow(_compare_tiles, "a long, b long")
    return found.where("key is null").select("a", "b").unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node with a link."""
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = stage(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        before = tuple(state)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    prints = stage(fingerprints(docs), "prints")
    return with_components(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def with_components(prints: DataFrame) -> DataFrame:
    """``prints`` with ``component_id``."""
    distinct = stage(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print")


def drop_near_duplicates(
    docs: DataFrame, size: int = similar_sets.SIZE, similarity: float = similar_sets.SIMILARITY
) -> DataFrame:
    """One row of each component with all its columns: that of the smallest ``doc_id``; null is larger than any other.

    Components are linked by fingerprints within ``DISTANCE``, as above, and by texts whose sets of ``size`` words in a
    row have a Jaccard similarity of at least ``similarity`` (see ``similar_sets``). Rows are told apart by id and text,
    so unrelated texts that share an id or have none are each judged by their own.
    """
    columns = docs.columns
    key = _free("__key", columns)
    keyed = docs.withColumn(key, _key())
    texts = keyed.select(F.col("doc_id").cast("long"), "text", F.col(key).alias("key"))
    prints = stage(texts.mapInArrow(_sketches(size), "doc_id long, print long, key string, set long, bands array<long>"), "prints")
    # Nulls last; each set gives its first row, then each component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    sets = stage(prints.groupBy("set").agg(first, F.first("bands").alias("bands")), "sets")
    # Links between fingerprints become links between the smallest sets that have them.
    distinct = stage(prints.groupBy("print").agg(F.min("set").alias("set")), "distinct")
    a, b = (distinct.select(F.col("print").alias(c), F.col("set").alias(f"of_{c}")) for c in "ab")
    known = links(distinct).join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    same = prints.select("print", F.col("set").alias("a")).distinct().join(distinct.withColumnRenamed("set", "b"), "print")
    known = stage(known.unionByName(same.where("a != b").select("a", "b")), "known")
    roots = similar_sets.set_links(
        sets.select("set", "first.key", "bands"), texts.select("key", "text"), known, components, size, similarity
    )
    named = sets.select("set", "first").join(roots, sets["set"] == roots["node"], "left")
    kept = named.groupBy(F.coalesce("root", "set")).agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    # Rows of one key have equal texts and with them one component. The key has no nulls, so the window reads the join's exchange.
    rest = keyed.join(kept, key, "left_semi")
    n = _free("__n", columns)
    repeats = Window.partitionBy(key).orderBy(row_hash(docs))
    return rest.withColumn(n, F.row_number().over(repeats)).where(F.col(n) == 1).select(*columns)


def _key() -> Column:
    """Id and digest of the text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), text)


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            prints = np.array([fingerprint(t) for t in text_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"]
            )


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", similar_sets.SLICE_BYTES):
                texts = text_bytes(batch.column("text"))
                prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
                sets = similar_sets.shingle_sets(texts, size)
                ids = np.array([similar_sets.set_id(s) for s in sets], dtype=np.uint64)
                keys = np.concatenate([similar_sets.band_keys(s) for s in sets]).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * similar_sets.BANDS, keys)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(prints.view(np.int64)), batch.column("key"), pa.array(ids.view(np.int64)), bands],
                    ["doc_id", "print", "key", "set", "bands"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            prints = whole.column("print").slice(at, 20_000).to_numpy()
            rows, keys = fuzzy_keys(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], ["key", "print"])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _stars(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links from each fingerprint to the smallest of its cluster, where clusters join by steps within the distance."""
    n = len(prints)
    near = np.zeros((n, n), dtype=bool)
    for at in range(0, n, 256):
        near[at : at + 256] = _bits(prints[at : at + 256, None] ^ prints[None, :]) <= DISTANCE
    label = np.arange(n)
    while True:
        was = label
        label = np.concatenate([np.where(near[at : at + 256], was, n).min(axis=1) for at in range(0, n, 256)])
        label = np.minimum(label, label[label])
        if (label == was).all():
            break
    # The links stand for paths of steps within the distance; all steps have been verified.
    moved = np.flatnonzero(label != np.arange(n))
    yield prints[moved], prints[label[moved]]


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], payload: str) -> Iterator[tuple]:
    """Runs of equal keys in sorted batches; the last run of a batch waits for the next one."""
    held = None
    for batch in batches:
        part = [batch.column(c).to_numpy() for c in (*names, payload)]
        if held is not None:
            part = [np.concatenate([h, p]) for h, p in zip(held, part)]
        n = len(part[0])
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for c in part[: len(names)]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        last = starts[-1]
        yield [p[:last] for p in part], starts[:-1]
        held = [p[last:] for p in part]
    if held is not None and len(held[0]):
        yield held, np.zeros(1, dtype=np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("blocks", pa.int32())])
    for (keys, prints), starts in _runs(batches, ("key",), "print"):
        if not len(keys):
            continue
        sizes = np.diff(np.r_[starts, len(keys)])
        found = []
        for n in np.unique(sizes[(sizes > 1) & (sizes <= 16)]).tolist():
            at = starts[sizes == n]
            rows = prints[at[:, None] + np.arange(n)]
            for i in range(n):
                for j in range(i):
                    near = _bits(rows[:, i] ^ rows[:, j]) <= DISTANCE
                    found.append((rows[near, i], rows[near, j]))
        for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
            if n <= RUN:
                found.extend(_stars(prints[s : s + n]))
            else:
                places = (np.arange(n) // RUN).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints[s : s + n]),
                        pa.nulls(n, pa.int64()),
                        pa.array(keys[s : s + n]),
                        pa.array(places),
                        pa.array(np.full(n, places[-1] + 1, np.int32)),
                    ],
                    schema=schema,
                )
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())],
                schema=schema,
            )


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (keys, _, _, prints), starts in _runs(batches, ("key", "i", "j"), "print"):
        for s, stop in zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist()):
            for a, b in _stars(np.unique(prints[s:stop])):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
