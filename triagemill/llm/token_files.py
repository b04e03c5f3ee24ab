"""Token ids in a binary file format: a static range asymmetric numeral system with interleaved lanes.

1. ``write_tokens`` tokenises each text once, appends the end id, and deals documents out to shards by ranges of
   ``doc_id`` (quantiles of that column). Each shard is sorted and staged, its ids compressed.
2. The counts of all ids give one frequency table of ``1 << SCALE`` slots, shared by every block. Its size follows from
   the vocabulary, and every id of the vocabulary has a slot.
3. Each shard is cut into blocks of about ``BLOCK`` ids at document borders. A block is coded on its own, ``LANES`` ids
   at a time, one per lane; every ``STRIDE`` steps it keeps a checkpoint (all lane states and the place in the stream)
   from which decoding can start, and its stream has a checksum. Blocks are rows of a Parquet table, so that Spark's
   commit protocol, not the operator, deals with lost executors, and any shared store can hold them.

``read_tokens`` decodes all checkpoints of a block side by side.

Words are looked up before they are encoded: no token of this vocabulary reaches over the border in front of a blank
that follows a character, so the ids of a text are those of its parts between such borders. The library encodes each
new part; for a part of Latin letters its model is asked directly.

Defined results: a null text counts as empty and has the end id only. Rows without ``doc_id`` come last; rows that
repeat an id stand in any order among themselves. An empty table gives an empty file set. One document lies whole in one
block.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import partitions, slices

END = 2
SCALE = 18
LANES = 2048
STRIDE = 256
BLOCK = 1 << 21
LOW = np.uint64(1 << 31)
MEMO = 800_000
SLICE_BYTES = 4 << 20
#: Letters up to here have been letters in every version of Unicode that the library may know.
LAST_LATIN = "\u024f"
#: Signs that stand for bytes in the vocabulary: printable Latin-1 for itself, the other bytes from U+0100 on in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_SIGNS = {**{b: chr(b) for b in _PRINTABLE}, **{b: chr(256 + i) for i, b in enumerate(_OTHERS)}}
BLANK_SIGN = BYTE_SIGNS[32]
TOKENS = "shard int, doc_id long, n long, ids binary"
BLOCKS = (
    "shard int, block int, first_token long, doc_ids array<long>, doc_sizes array<long>, n_tokens long, "
    "checkpoints binary, stream binary, crc32 long"
)


class Words:
    """Ids of texts by a memo of their parts."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.tokenizer = None
        self.memo: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "tokenizer": None, "memo": {}, "bare": {}}

    def _load(self) -> None:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.tokenizer = tokenizers.Tokenizer.from_str(self.vocabulary)
            self.model = self.tokenizer.model
            self.line = np.array(self._ids(["\n"])[0], np.uint32)
            self.stops = {"": b"", **{c: _packed(ids) for c, ids in zip(",.", self._ids([",", "."]))}}

    def _ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _letters(self, word: str, front: str, memo: dict[str, bytes]) -> bytes | None:
        """Ids of a word of Latin letters, perhaps with a comma or stop behind it; None for any other.

        The letters are one piece for the model, so the splitting of texts into pieces is not needed.
        """
        stop = word[-1:] if word[-1:] in (",", ".") else ""
        letters = word[:-1] if stop else word
        if not letters.isalpha() or max(letters) > LAST_LATIN:
            return None
        ids = memo.get(letters)
        if ids is None:
            shown = letters if letters.isascii() else "".join(map(BYTE_SIGNS.__getitem__, letters.encode()))
            ids = memo[letters] = array("I", [t.id for t in self.model.tokenize(front + shown)]).tobytes()
        return ids + self.stops[stop]

    def _learn(self, words: set[str]) -> None:
        """Ids of each word with a blank in front. A single line end between letters is a piece of its own."""
        memo, rest, line = self.memo, [], self.line.tobytes()
        for word in words:
            first, cut, second = word.partition("\n")
            ids = self._letters(first, BLANK_SIGN, memo)
            if cut and ids is not None:
                after = self._letters(second, "", self.bare)
                ids = None if after is None else ids + line + after
            if ids is None:
                rest.append(word)
            else:
                memo[word] = ids
        # Other words without white space are encoded together, a line end between.
        lone = [w for w in rest if "<|" in w or _BLANK.search(w)]
        for word, ids in zip(lone, self._ids([" " + w for w in lone])):
            memo[word] = _packed(ids)
        plain = list(set(rest).difference(lone))
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            ids = np.array(self._ids([" " + "\n ".join(part) + "\n"])[0], np.uint32)
            raw, start = ids.tobytes(), 0
            for word, stop in zip(part, (4 * np.flatnonzero(ids == self.line[0])).tolist()):
                memo[word] = raw[start:stop]
                start = stop + 4

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        self._load()
        split = [t.split(" ") for t in texts]
        tails = [self._tail(words) for words in split]
        used = set().union(*(words[1:] for words in split))
        if len(self.memo) + len(self.bare) > MEMO:
            # What these texts use stays, and with it the frequent words.
            self.memo = {w: self.memo[w] for w in used if w in self.memo}
            self.bare.clear()
        memo = self.memo
        new = used.difference(memo)
        # A part that is empty or ends in white space belongs together with the blank behind it. None is ever learned.
        odd = {w for w in new if open_ended(w)}
        changed = False
        for i, words in enumerate(split):
            if len(words) > 1 and (open_ended(words[0]) or odd and not odd.isdisjoint(words)):
                split[i] = re.split(r"(?<=\S) ", texts[i])
                tails[i] = self._tail(split[i])
                changed = True
        if changed:
            new = set().union(*(words[1:] for words in split)).difference(memo)
        self._learn(new)
        heads = self._heads([words[0] for words in split])
        ends = [self._ids([tail])[0] if tail else [] for tail in tails]
        get = memo.__getitem__
        return [
            np.frombuffer(b"".join([head, *map(get, words[1:]), _packed(end)]), np.uint32)
            for head, words, end in zip(heads, split, ends)
        ]

    def _heads(self, heads: list[str]) -> list[bytes]:
        """Ids of the first parts of texts, which have no blank in front."""
        out = [self._letters(head, "", self.bare) for head in heads]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._ids([heads[i] for i in rest])):
            out[i] = _packed(ids)
        return out

    @staticmethod
    def _tail(words: list[str]) -> str:
        """Takes off the last part if white space ends it, and returns it with its blank."""
        return " " + words.pop() if len(words) > 1 and open_ended(words[-1]) else ""


_BLANK = re.compile(r"\s")


def open_ended(part: str) -> bool:
    return not part or part[-1].isspace()


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes() if ids else b""


class Table:
    """Slots of each id: at least one, the rest in proportion to its count."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        if size >= 1 << SCALE:
            raise ValueError(f"{size} ids need more than {1 << SCALE} slots")
        room = (1 << SCALE) - size
        total = int(counts.sum())
        self.freq = np.ones(size, dtype=np.uint64)
        if total:
            self.freq += np.floor(counts * (room / total)).astype(np.uint64)
        self.freq[int(np.argmax(counts))] += np.uint64((1 << SCALE) - int(self.freq.sum()))
        self.start = np.cumsum(self.freq) - self.freq
        self.of_slot = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Checkpoints and stream. A checkpoint is its place in the stream and the state of every lane."""
        n, scale = len(ids), np.uint64(SCALE)
        steps = -(-n // LANES)
        state = np.full(LANES, LOW, dtype=np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        marks = []
        for t in range(steps - 1, -1, -1):
            now = ids[t * LANES : (t + 1) * LANES]
            f = self.freq[now]
            x = state[: len(now)]
            over = x >= f << np.uint64(63 - SCALE)
            words[t] = x[over].astype(np.uint32)
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            state[: len(now)] = (q << scale) + (x - q * f) + self.start[now]
            if t % STRIDE == 0:
                marks.append((t, state.copy()))
        places = np.cumsum([0, *map(len, words)])
        kept = [np.r_[np.uint64(places[t]), s].astype("<u8").tobytes() for t, s in reversed(marks)]
        return b"".join(kept), np.concatenate([np.zeros(0, np.uint32), *words]).astype("<u4").tobytes()

    def decode(self, checkpoints: bytes, stream: bytes, n: int) -> np.ndarray:
        """All ids of a block; its checkpoints advance together."""
        marks = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)
        words = np.frombuffer(stream, "<u4").astype(np.uint64)
        count, low = len(marks), np.uint64((1 << SCALE) - 1)
        out = np.zeros((count, STRIDE, LANES), dtype=np.uint32)
        state, place = marks[:, 1:].copy(), marks[:, 0].astype(np.int64)
        for t in range(min(STRIDE, -(-n // LANES))):
            live = np.clip(n - (np.arange(count) * STRIDE + t) * LANES, 0, LANES)
            slot = state & low
            now = self.of_slot[slot.astype(np.int64)]
            out[:, t] = now
            x = self.freq[now] * (state >> np.uint64(SCALE)) + slot - self.start[now]
            under = (x < LOW) & (np.arange(LANES) < live[:, None])
            order = np.cumsum(under, axis=1) - 1
            at = (place[:, None] + order)[under]
            x[under] = x[under] << np.uint64(32) | words[at]
            place += under.sum(axis=1)
            state = x
        return out.reshape(-1)[:n] if count else np.zeros(0, np.uint32)


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """Ids that end all shards but the last, as quantiles of ``doc_id``."""
    if shards == 1:
        return np.zeros(0, np.int64)
    points = ", ".join(str(i / shards) for i in range(1, shards))
    found = docs.agg(F.expr(f"percentile_approx(CAST(doc_id AS BIGINT), array({points}), {20 * shards})")).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def write_tokens(docs: DataFrame, vocabulary_file: str, name: str = "token-blocks") -> tuple[DataFrame, Table]:
    """The block table of ``docs``, written to the shared folder, and the frequency table to decode it with."""
    spark = docs.sparkSession
    with open(vocabulary_file, encoding="utf-8") as f:
        vocabulary = f.read()
    size = max(END + 1, tokenizers.Tokenizer.from_str(vocabulary).get_vocab_size(with_added_tokens=True))
    shards = partitions(docs)
    bounds = shard_bounds(docs, shards)
    words = spark.sparkContext.broadcast(Words(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(words, bounds, size), TOKENS)
    order = (F.col("shard"), F.col("doc_id").asc_nulls_last())
    tokens = stage(rows.repartition(shards, "shard").sortWithinPartitions(*order), "tokens")
    counted = tokens.select("ids").mapInArrow(_count(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, dtype=np.int64)
    for r in counted.collect():
        counts[r.id] = r.n
    table = Table(counts)
    held = spark.sparkContext.broadcast(table)
    # The staged files may be cut and joined at will by the reader, so shards are brought together by the file's order.
    dealt = tokens.repartition(shards, "shard").sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(_encode(held, size), BLOCKS), name), table


def read_tokens(blocks: DataFrame, table: Table) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (ids as little-endian uint32) read back from the blocks."""
    return blocks.mapInArrow(_decode(*_opened(blocks, table), False), "doc_id long, start long, n_tokens long, ids binary")


def token_digests(blocks: DataFrame, table: Table) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the blocks."""
    return blocks.mapInArrow(
        _decode(*_opened(blocks, table), True), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _opened(blocks: DataFrame, table: Table) -> tuple:
    """The decoding table, and the ids before each shard: one number per shard, of which there are as many as partitions."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, total = {}, 0
    for r in sizes:
        before[r.shard] = total
        total += r.n
    return blocks.sparkSession.sparkContext.broadcast(table), before


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _tokenise(held, bounds: np.ndarray, size: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = held.value, zstandard.ZstdCompressor(1)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids = words.encode([t or "" for t in batch.column("text").to_pylist()])
                doc_ids = batch.column("doc_id").to_pylist()
                shard = [len(bounds) if d is None else int(np.searchsorted(bounds, d)) for d in doc_ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard, pa.int32()),
                        batch.column("doc_id"),
                        pa.array([len(i) + 1 for i in ids], pa.int64()),
                        pa.array([pack.compress(np.r_[i, END].astype(_kind(size)).tobytes()) for i in ids], pa.binary()),
                    ],
                    ["shard", "doc_id", "n", "ids"],
                )

    return tokenise


def _count(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                packed = batch.column("ids").slice(at, 1000).to_pylist()
                ids = np.frombuffer(b"".join(map(unpack.decompress, packed)), _kind(size))
                total += np.bincount(ids, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return count


def _encode(held, size: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unpack = held.value, zstandard.ZstdDecompressor()
        shard, block, first, docs, parts, n = None, 0, 0, [], [], 0

        def flush():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            checkpoints, stream = table.encode(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                    pa.array([n], pa.int64()),
                    pa.array([checkpoints], pa.binary()),
                    pa.array([stream], pa.binary()),
                    pa.array([zlib.crc32(stream)], pa.int64()),
                ],
                ["shard", "block", "first_token", "doc_ids", "doc_sizes", "n_tokens", "checkpoints", "stream", "crc32"],
            )

        for batch in batches:
            for s, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))):
                ids = np.frombuffer(unpack.decompress(packed), _kind(size)).astype(np.uint32)
                if parts and (s != shard or n + len(ids) > BLOCK):
                    yield flush()
                    block, first, docs, parts, n = block + 1, first + n, [], [], 0
                if s != shard:
                    shard, block, first = s, 0, 0
                docs.append(doc_id)
                parts.append(ids)
                n += len(ids)
        if parts:
            yield flush()

    return encode


def _decode(held, before: dict[int, int], digest: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        names = ("shard", "first_token", "doc_ids", "doc_sizes", "n_tokens", "checkpoints", "stream", "crc32")
        for batch in batches:
            for shard, first, docs, sizes, n, checkpoints, stream, crc in zip(
                *(batch.column(c).to_pylist() for c in names)
            ):
                if zlib.crc32(stream) != crc:
                    raise ValueError(f"shard {shard}: a block at id {first} fails its checksum")
                raw = table.decode(checkpoints, stream, n).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - np.array(sizes)
                each = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(starts + first + before[shard], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return decode


def tokenise_to_files(spark: SparkSession, docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Write the ids of ``docs``, and return ``doc_id, start, n_tokens, ids_crc32`` read back from the files."""
    return token_digests(*write_tokens(docs, vocabulary_file))
