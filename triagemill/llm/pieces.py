"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file of a public tokenizer is read on the driver; its pieces become a trie in two integer arrays
(``base`` and ``check``, plus the piece that ends at each state), which is broadcast: its size follows from the
vocabulary alone. Texts get the whitespace marker in place of each blank and one marker in front. Where no piece
crosses from a character to a marker behind it, the best path of a text is the best paths of its words one after the
other; so each batch looks up its distinct words, and all words of equal length that are new run through the Viterbi
recursion together. A character without a piece costs ten less than the worst piece and is written as its bytes.

Decoding puts pieces and bytes together, turns markers into blanks, and drops the first one.

Defined results: a null text counts as empty and has no ids. A marker character inside a text is read as a blank, so
such a text comes back with blanks in its place. All texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
MARK_BYTES = MARK.encode()
UNKNOWN_PENALTY = 10.0
MEMO = 150_000
SLICE_BYTES = 1 << 20
ENCODED = "doc_id long, n_tokens long, n_byte_tokens long, ids array<int>, text string, round_trip boolean"


class Trie:
    """Double-array trie over bytes. State 0 is the root; ``base[s] + byte + 1`` is a child if its check is ``s``."""

    def __init__(self, words: dict[bytes, int]):
        children: dict[bytes, set[int]] = {b"": set()}
        for word in words:
            for i, byte in enumerate(word):
                children.setdefault(word[:i], set()).add(byte)
        # Every child of a state lies within 257 places of its base; each prefix takes one place.
        size = 2 * len(children) + (1 << 16)
        self.base, self.check, self.value = (np.full(size, x, dtype=np.int32) for x in (0, -1, -1))
        taken = np.zeros(size, dtype=bool)
        taken[0] = True
        # Searches for as many children start where the last one ended: places left before it are mostly too narrow.
        starts = [0] * 257
        queue = [(b"", 0)]
        for prefix, state in queue:
            if prefix in words:
                self.value[state] = words[prefix]
            kids = np.array(sorted(children.get(prefix, ())), dtype=np.int64)
            if not len(kids):
                continue
            at = starts[len(kids)] = self._room(taken, kids, starts[len(kids)])
            self.base[state] = at
            taken[at + kids + 1] = True
            self.check[at + kids + 1] = state
            queue += [(prefix + bytes([k]), at + k + 1) for k in kids.tolist()]

    @staticmethod
    def _room(taken: np.ndarray, kids: np.ndarray, at: int) -> int:
        """The first base from ``at`` on whose places for all children are free."""
        while True:
            fits = np.ones(1024, dtype=bool)
            for k in kids.tolist():
                fits &= ~taken[at + k + 1 : at + k + 1025]
            if fits.any():
                return at + int(fits.argmax())
            at += 1024


class Pieces:
    """The pieces of a vocabulary, its encoder and its decoder."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(count)], dtype=np.float64)
        self.byte_ids = np.full(256, model.unk_id(), dtype=np.int32)
        self.raw: list[bytes] = []
        words: dict[bytes, int] = {}
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"" if not model.is_unknown(i) else " ⁇ ".encode())
            else:
                words[piece.encode()] = i
                self.raw.append(piece.replace(MARK, " ").encode())
        self.is_byte = np.zeros(count, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.trie = Trie(words)
        self.unknown = min((self.scores[i] for i in words.values()), default=0.0) - UNKNOWN_PENALTY
        #: Whether every piece has its markers in front, so that words are independent.
        self.by_word = not any(MARK in w.decode().lstrip(MARK) for w in words)
        self.memo: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def viterbi(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32) of the best path of each word (bytes with markers)."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        ends = np.flatnonzero(np.diff(np.r_[sizes, -1])) + 1
        start = 0
        for stop in ends.tolist():
            n = int(sizes[start])
            step = max(1, (1 << 20) // max(1, n))
            for at in range(start, stop, step) if n else ():
                rows = order[at : min(stop, at + step)].tolist()
                for row, ids in zip(rows, self._paths([words[i] for i in rows], n)):
                    out[row] = ids
            start = stop
        return out

    def _paths(self, words: list[bytes], n: int) -> Iterator[bytes]:
        count = len(words)
        text = np.frombuffer(b"".join(words), np.uint8).reshape(count, n).T.astype(np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, count), dtype=np.int32)
        piece = np.full((n + 1, count), -1, dtype=np.int32)
        first = (text & 0xC0) != 0x80
        width = 1 + (text >= 0xC0).astype(np.int32) + (text >= 0xE0) + (text >= 0xF0)
        for start in range(n):
            rows = np.flatnonzero(first[start])
            if not len(rows):
                continue
            single = np.zeros(count, dtype=bool)
            alive, state = rows, np.zeros(len(rows), dtype=np.int32)
            for stop in range(start + 1, n + 1):
                to = base[state] + text[stop - 1, alive] + 1
                ok = check[to] == state
                alive, state = alive[ok], to[ok]
                if not len(alive):
                    break
                ends = value[state]
                full = ends >= 0
                if full.any():
                    at, ids = alive[full], ends[full]
                    single[at[width[start, at] == stop - start]] = True
                    score = best[start, at] + self.scores[ids]
                    better = score > best[stop, at]
                    at, ids = at[better], ids[better]
                    best[stop, at], back[stop, at], piece[stop, at] = score[better], start, ids
            lone = rows[~single[rows]]
            if len(lone):
                stops = np.minimum(start + width[start, lone], n)
                score = best[start, lone] + self.unknown
                better = score > best[stops, lone]
                at, stops = lone[better], stops[better]
                best[stops, at], back[stops, at], piece[stops, at] = score[better], start, -1
        # Walk all paths back at once; -2 stands behind the start of a word.
        at, each = np.full(count, n), np.arange(count)
        taken = []
        while at.any():
            taken.append(np.where(at > 0, piece[at, each], -2))
            at = back[at, each]
        path = np.stack(taken[::-1], axis=1)
        flat, ends = path[path >= 0].tobytes(), 4 * np.cumsum((path >= 0).sum(axis=1))
        unknown = (path == -1).any(axis=1)
        for i, (first, last, lone) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), unknown.tolist())):
            yield self._with_bytes(words[i], back[:, i], piece[:, i]) if lone else flat[first:last]

    def _with_bytes(self, word: bytes, back: np.ndarray, piece: np.ndarray) -> bytes:
        """The path of a word with characters that have no piece."""
        ids, at = [], len(word)
        while at:
            start = int(back[at])
            ids += [piece[at]] if piece[at] >= 0 else self.byte_ids[list(word[start:at])][::-1].tolist()
            at = start
        return np.array(ids[::-1], dtype=np.int32).tobytes()

    def _words(self, text: str) -> list[str]:
        """Words of a text, each without the marker before it; markers that follow a marker stay with the next word."""
        if not self.by_word:
            return [text.replace(" ", MARK)]
        words = text.split(" ")
        if "" in words or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            words = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self._words(t) if t else [] for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list({w for words in split for w in words if w not in memo})
        for word, ids in zip(new, self.viterbi([MARK_BYTES + w.replace(" ", MARK).encode() for w in new])):
            memo[word] = ids
        get = memo.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode(errors="replace")


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, ids, text, round_trip``; ``text`` is decoded from ``ids``."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(held), ENCODED)


def _encode(held):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = pieces.encode(texts)
                decoded = [pieces.decode(i) for i in ids]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids)
                of_bytes = np.r_[0, np.cumsum(pieces.is_byte[flat])]
                offsets = np.r_[0, np.cumsum(counts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(counts),
                        pa.array(of_bytes[offsets[1:]] - of_bytes[offsets[:-1]], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                        pa.array(decoded, pa.string()),
                        pa.array([t.replace(MARK, " ") == d for t, d in zip(texts, decoded)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids", "text", "round_trip"],
                )

    return encode
