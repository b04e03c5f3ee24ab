"""Near copies by the Jaccard similarity of their shingles: MinHash bands propose pairs, the shingles decide.

A text's set holds a 64-bit hash of each run of ``size`` lower-cased words, or of all its words if there are fewer. Texts
with equal sets are merged. A set has ``BANDS`` keys, each a hash of ``ROWS`` minima; sets of similarity s share a key
with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.9994 at 0.8.

Components of links that are already known come first. Then, in rounds, only keys that hold sets of several components
are looked at, so a settled cluster gives no row at all. In each such key the sets of other components are compared with
its leaders: one in the first round, ``LEADERS`` in later ones. A leader has then met every set of its key that it is not
connected with, and leaves the key. The rounds end when no key holds two components any longer, and then every pair
that shares a key has been compared or is connected. Where very many sets share a key without resembling each other,
rounds find little: after ``QUIET`` rounds in a row that found no link, all sets of each key that is still open are
compared, in tiles of bounded size (see ``_unmet``). So every pair that shares a key is decided.

Defined results: a text without words has the empty set, which resembles no other; all such texts are equal. Texts that
differ in nothing but case, blanks or the order and number of equal shingles have equal sets and are merged. Ties do not
occur, since links have no order. No rows give no links. Sets and shingles are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import LOWER, partitions, slices, text_bytes
from .word_hashes import mixed

SIZE = 5
SIMILARITY = 0.8
ROWS = 8
BANDS = 40
LEADERS = 4
QUIET = 2
#: Sets of a block, and bytes of their shingles; two blocks meet in a task.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: A shingle of so many sets of a tile gives its pairs one by one; others are so many columns of a matrix at a time.
FEW, COLUMNS = 8, 2048
SLICE_BYTES = 1 << 18
_SEED = np.random.Generator(np.random.PCG64(20_240_805))
_FLIP = _SEED.integers(0, 1 << 32, (ROWS * BANDS, 1), dtype=np.uint32)
_TIMES = _SEED.integers(0, 1 << 31, (ROWS * BANDS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, from a hash of the bytes of each word."""
    out = []
    for text in texts:
        split = text.translate(LOWER).split()
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
        found = np.zeros(max(1, len(words) - size + 1) if len(words) else 0, np.uint64)
        for i in range(min(size, len(words))):
            found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(found)])
        out.append(np.unique(found))
    return out


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; an empty set, which no other resembles, has keys too."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[None, at : at + 1024] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def set_links(
    sets: DataFrame, docs: DataFrame, known: DataFrame, components: Callable, size: int = SIZE, similarity: float = SIMILARITY
) -> DataFrame:
    """``node, root``: components of ``known`` links ``a, b`` and those of similar sets.

    ``sets`` has ``set, key, bands`` for each set, ``docs`` the texts as ``key, text``.
    """
    keys = sets.select("set", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").count().where("count > 1").select("band")
    keys = stage(keys.join(shared, "band"), "bands")
    roots, turn, quiet = stage(components(known), "roots"), 0, 0
    members = _open(keys, roots)
    wanted = sets.join(members.select("set").distinct(), "set", "left_semi").select("key").distinct()
    held = docs.join(wanted, "key", "left_semi").select("text").mapInArrow(_shingles(size), "set long, shingles binary")
    held = stage(held.dropDuplicates(["set"]), "sets")
    while quiet < QUIET and not members.isEmpty():
        # The same set leads most keys of a cluster at first; then each key has leaders of its own.
        rank = F.xxhash64("set", "band", F.lit(turn)) if turn else F.col("set")
        first = Window.partitionBy("band").orderBy(rank, "set")
        leaders = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= (LEADERS if turn else 1))
        leaders = stage(leaders.select("band", F.col("set").alias("lead"), F.col("root").alias("lead_root")), "leaders")
        met = members.join(leaders, "band").where("root != lead_root")
        pairs = met.select(F.greatest("set", "lead").alias("a"), F.least("set", "lead").alias("b")).distinct()
        one = held.select(F.col("set").alias("a"), F.col("shingles").alias("left"))
        two = held.select(F.col("set").alias("b"), F.col("shingles").alias("right"))
        new = stage(pairs.join(one, "a").join(two, "b").mapInArrow(_similar(similarity), "a long, b long"), "similar")
        if new.isEmpty():
            quiet += 1
        else:
            quiet = 0
            roots = _joined(roots, new, components)
        done = leaders.select("band", F.col("lead").alias("set"))
        members = _open(members.join(done, ["band", "set"], "left_anti"), roots)
        turn += 1
    if not members.isEmpty():
        new = stage(_unmet(members, held, similarity), "similar")
        if not new.isEmpty():
            roots = _joined(roots, new, components)
    return roots


def _unmet(members: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that connect every two similar sets of different components that share a key.

    The sets of a key are dealt to blocks of about ``BLOCK`` sets or ``BLOCK_BYTES``, and every two blocks meet in one task, which counts the
    shingles of all pairs at once. Only links between clusters leave it.
    """
    n = partitions(members)
    sized = members.join(held.select("set", F.octet_length("shingles").alias("bytes")), "set")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    sizes = sized.groupBy("band").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "band").withColumn("place", F.expr("cast(pmod(xxhash64(set, band), blocks) as int)"))
    sides = F.expr(
        "transform(sequence(0, blocks - 1), o -> struct(least(place, o) as i, greatest(place, o) as j))"
    )
    tiles = placed.select("band", "set", "root", F.explode(sides).alias("t")).select("band", "t.*", "set", "root")
    tiles = tiles.join(held, "set").repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "set")
    return tiles.select("band", "i", "j", "set", "root", "shingles").mapInArrow(_tiles(similarity), "a long, b long").distinct()


def _tiles(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, roots, shingles = None, [], [], []

        def links() -> pa.RecordBatch:
            a, b = near_links(np.array(sets, np.int64), np.array(roots, np.int64), shingles, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("band", "i", "j", "set", "root")]
            for tile, one, root, held in zip(zip(*columns[:3]), *columns[3:], batch.column("shingles")):
                if tile != now:
                    if len(sets) > 1:
                        yield links()
                    now, sets, roots, shingles = tile, [], [], []
                sets.append(one)
                roots.append(root)
                # A copy, so that no batch is held longer than it is read.
                shingles.append(np.frombuffer(held.as_py(), np.uint64))
        if len(sets) > 1:
            yield links()

    return run


def shared_counts(shingles: list[np.ndarray]) -> np.ndarray:
    """For every two sets the number of shingles they share."""
    n = len(shingles)
    owners = np.repeat(np.arange(n), [len(s) for s in shingles])
    every = np.concatenate([np.zeros(0, np.uint64), *shingles])
    order = np.argsort(every, kind="stable")
    every, owners = every[order], owners[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(every)])
    counts = np.zeros((n, n), np.float32)
    # A shingle of few sets gives its pairs; those of many are columns of a matrix.
    for size in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():
        at = starts[sizes == size]
        rows = owners[at[:, None] + np.arange(size)]
        for i in range(size):
            for j in range(i):
                np.add.at(counts, (rows[:, i], rows[:, j]), 1)
                np.add.at(counts, (rows[:, j], rows[:, i]), 1)
    many, last = starts[sizes > FEW], (starts + sizes)[sizes > FEW]
    for at in range(0, len(many), COLUMNS):
        matrix = np.zeros((n, min(COLUMNS, len(many) - at)), np.float32)
        for k, (first, stop) in enumerate(zip(many[at : at + COLUMNS].tolist(), last[at : at + COLUMNS].tolist())):
            matrix[owners[first:stop], k] = 1
        counts += matrix @ matrix.T
    return counts


def near_links(
    sets: np.ndarray, roots: np.ndarray, shingles: list[np.ndarray], similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Links from each set to the smallest of its cluster, where clusters join by similar sets of different roots."""
    n = len(sets)
    sizes = np.array([len(s) for s in shingles], np.float64)
    both = shared_counts(shingles)
    near = np.zeros((n, n), bool)
    for i in range(n):
        union = sizes[i] + sizes - both[i]
        near[i] = (both[i] > 0) & (roots != roots[i]) & (both[i] / np.maximum(union, 1) >= similarity)
        near[i, i] = True
    label = np.arange(n)
    while True:
        was = label
        label = np.array([was[near[i]].min() for i in range(n)])
        label = np.minimum(label, label[label])
        if (label == was).all():
            break
    # The links stand for paths of similar sets.
    moved = np.flatnonzero(label != np.arange(n))
    return sets[moved], sets[label[moved]]


def _joined(roots: DataFrame, new: DataFrame, components: Callable) -> DataFrame:
    """``roots`` after more links: only the links between components are followed, then each component is named anew."""
    of_a, of_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}")) for c in "ab")
    ends = new.join(of_a, "a", "left").join(of_b, "b", "left")
    up = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    up = stage(up, "joined")
    names = up.select(F.col("node").alias("root"), F.col("root").alias("now"))
    # A component's root is no node of ``roots``, since it is not linked to anything smaller.
    named = roots.join(names, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return stage(named.unionByName(up), "roots")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, set, root`` of the keys that hold sets of several components."""
    of = roots.select(F.col("node").alias("set"), F.col("root").alias("now"))
    named = members.select("band", "set").join(of, "set", "left")
    named = stage(named.select("band", "set", F.coalesce("now", "set").alias("root")), "members")
    several = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return stage(named.join(several.select("band"), "band", "left_semi"), "open")


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = shingle_sets(text_bytes(batch.column("text")), size)
                ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "shingles"]
                )

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("left"), batch.column("right")):
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0
                keep.append(both > 0 and both / (len(a) + len(b) - both) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run
