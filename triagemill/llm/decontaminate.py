"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts and items are lower-cased (A-Z) and cut into words. The automaton takes the word sequences of all items; a
document's words stream through it, and the state tells the longest suffix read so far that some item holds. Where that
length reaches the window, the last words are a window of an item; items shorter than the window count when they are
read whole. The word ids of a document are first tested in bulk for runs of word pairs that items hold, so that only
such runs stream through the automaton.

Items are dealt into automata of at most ``AUTOMATON_WORDS`` words by the running total of their sizes, so what is
broadcast has a fixed bound; each further automaton costs another pass over the documents, and the hits are merged by
document. An item longer than the bound makes an automaton of its own in overlapping pieces.

Defined results: null texts have no words; an item without words has no window; rows of ``benchmark`` that repeat an id
count as one item. A null ``item_id`` counts as a hit but is not listed. Rows of ``docs`` are told apart even where ids
repeat or are null. Without items or documents nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes

WINDOW = 10
AUTOMATON_WORDS = 500_000
SLICE_BYTES = 4 << 20
#: Lower case and a blank for each ASCII byte that is neither a digit nor a letter.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HITS = "row long, doc_id long, n_words long, spans binary, items array<string>, null_item boolean"
MERGED = "row long, doc_id long, n_words long, n_hit long, spans binary, items array<string>, null_item boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton over the word sequences of several items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: Items that hold the window which ends at a state, and short items which end there, by their length.
        self.full: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        sequences = []
        for name, words in items:
            if words:
                sequence = [self.ids.setdefault(w, len(self.ids)) for w in words]
                self._add(sequence)
                sequences.append((name, sequence))
        for name, sequence in sequences:
            self._mark(name, sequence)
        self._short_chain: dict[int, tuple] = {}
        self.least = min((min(len(s), window) for _, s in sequences), default=0)
        size = 1 << max(12, (4 * sum(len(s) for _, s in sequences)).bit_length())
        self.pairs = np.zeros(size, dtype=bool)
        for _, s in sequences:
            a = np.array(s, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) & (len(self.pairs) - 1)

    def _state(self, length: int, step: dict, link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int) -> int:
        """The state for ``at`` + ``word`` with exactly that length, cloned if it is longer."""
        to = self.step[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        clone = self._state(self.length[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = clone
        while at != -1 and self.step[at].get(word) == to:
            self.step[at][word] = clone
            at = self.link[at]
        return clone

    def _add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.step[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, {}, -1)
            at = last
            while at != -1 and word not in self.step[at]:
                self.step[at][word] = new
                at = self.link[at]
            self.link[new] = 0 if at == -1 else self._split(at, word)
            last = new

    def _walk(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length of the longest suffix read so far that an item holds."""
        state = length = 0
        step, link, lengths = self.step, self.link, self.length
        for i, word in enumerate(sequence):
            while state and word not in step[state]:
                state = link[state]
                length = lengths[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            else:
                state = length = 0
            yield i, state, length

    def _top(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, name, sequence: list[int]) -> None:
        short = len(sequence) < self.window
        for i, state, length in self._walk(sequence):
            if not short and length >= self.window:
                self.full.setdefault(self._top(state, self.window), set()).add(name)
            elif short and i == len(sequence) - 1:
                self.short.setdefault(self._top(state, len(sequence)), []).append((len(sequence), name))

    def _shorts(self, state: int) -> tuple:
        """Short items that are suffixes of the state's longest string."""
        if state not in self._short_chain:
            chain, at = [], state
            while at > 0:
                chain += self.short.get(at, ())
                at = self.link[at]
            self._short_chain[state] = tuple(chain)
        return self._short_chain[state]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words lie in an occurrence of a window (None: none does), and the items that occur."""
        found: set = set()
        if not self.least or len(words) < self.least:
            return None, found
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        mask = None
        for start, stop in self._runs(ids):
            for i, state, length in self._walk(ids[start:stop].tolist()):
                size = 0
                if length >= self.window:
                    size = self.window
                    found |= self.full[self._top(state, size)]
                if self.short:
                    for n, name in self._shorts(state):
                        if n <= length:
                            size = max(size, n)
                            found.add(name)
                if size:
                    if mask is None:
                        mask = np.zeros(len(words), dtype=bool)
                    mask[start + i + 1 - size : start + i + 1] = True
        return mask, found

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of at least ``least`` words in which each pair of neighbours may stand in an item."""
        if self.least == 1:
            joined = ids >= 0
            edges = np.flatnonzero(np.diff(np.r_[False, joined, False]))
            return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        a, b = ids[:-1], ids[1:]
        joined = self.pairs[self._pair(a, b)] & (a >= 0) & (b >= 0)
        edges = np.flatnonzero(np.diff(np.r_[False, joined, False]))
        starts, stops = edges[::2], edges[1::2] + 1
        long = stops - starts >= self.least
        return list(zip(starts[long].tolist(), stops[long].tolist()))


def item_texts(items: DataFrame) -> DataFrame:
    """``item_id`` as a string and the text of each item; equal rows once."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.distinct()


def automata(items: DataFrame, window: int, most_words: int) -> Iterator[ItemAutomaton]:
    """Automata over all items, each of at most ``most_words`` words, built one after the other."""
    held: list[tuple[str | None, list[bytes]]] = []
    total = 0
    for row in item_texts(items).toLocalIterator():
        words = words_of(row.text.encode())
        # Pieces of a very long item share window - 1 words, so each of its windows lies in one of them.
        step = max(1, most_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step) if len(words) > most_words else (0,):
            piece = words[at : at + most_words] if len(words) > most_words else words
            if held and total + len(piece) > most_words:
                yield ItemAutomaton(held, window)
                held, total = [], 0
            held.append((row.item_id, piece))
            total += len(piece)
    yield ItemAutomaton(held, window)


def item_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``row, doc_id, n_words, spans, items, null_item`` per row and automaton; ``spans`` packs word ranges as int32."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    parts = []
    for automaton in automata(items, window, most_words):
        held = spark.sparkContext.broadcast(automaton)
        parts.append(numbered.mapInArrow(_scan(held), HITS))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """``row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for each row of ``docs``."""
    found = item_hits(docs, items, window, most_words)
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.collect_list("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("null_item").alias("null_item"),
    )
    return merged.mapInArrow(_merge_spans, MERGED).select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("null_item").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    longest: int = WINDOW,
    coverage: float = 0.2,
    window: int = WINDOW,
    most_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """``docs`` without what they share with the items.

    A document with a hit run of ``longest`` words or more, or with more than the share ``coverage`` of its words hit,
    is test material and goes as a whole. Shorter hits, from items below the window, are cut out of the text: from the
    first character of the run to the character before the next word. ``n_chars``, if present, follows the new text.
    """
    spans = "__spans"
    while spans in docs.columns:
        spans += "_"
    # All but the last automaton only note their hits; one decision is then taken on the whole of them.
    noted = T.StructType([*docs.schema.fields, T.StructField(spans, T.BinaryType())])
    out = docs
    dealt = automata(items, window, most_words)
    automaton = next(dealt)
    while automaton is not None:
        held, automaton = docs.sparkSession.sparkContext.broadcast(automaton), next(dealt, None)
        if automaton is None:
            out = out.mapInArrow(_cut(held, spans, longest, coverage), docs.schema)
        else:
            out = out.mapInArrow(_note(held, spans), noted)
    return out


def _scan(held):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                counts, spans, names, nulls = [], [], [], []
                for text in text_bytes(batch.column("text")):
                    words = words_of(text)
                    mask, found = automaton.hits(words)
                    counts.append(len(words))
                    spans.append(b"" if mask is None else _ranges(mask).astype("<i4").tobytes())
                    names.append([n for n in found if n is not None])
                    nulls.append(None in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.binary()),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array(nulls, pa.bool_()),
                    ],
                    ["row", "doc_id", "n_words", "spans", "items", "null_item"],
                )

    return scan


def _ranges(mask: np.ndarray) -> np.ndarray:
    """Starts and stops of the runs of True, one after the other."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False]))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, merged = [], []
        for n, lists in zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist()):
            lists = [s for s in lists if s]
            if not lists:
                n_hit.append(0)
                merged.append(b"")
                continue
            mask = np.zeros(n, dtype=bool)
            for packed in lists:
                for start, stop in np.frombuffer(packed, "<i4").reshape(-1, 2).tolist():
                    mask[start:stop] = True
            n_hit.append(int(mask.sum()))
            merged.append(_ranges(mask).astype("<i4").tobytes())
        names = ["row", "doc_id", "n_words", "n_hit", "spans", "items", "null_item"]
        made = {"n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(merged, pa.binary())}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)


def _all_hits(automaton: ItemAutomaton, batch: pa.RecordBatch, spans: str) -> Iterator[tuple[bytes, np.ndarray | None]]:
    """For each text its bytes and which of its words are hit, by this automaton or those that noted ``spans``."""
    noted = batch.column(spans).to_pylist() if spans in batch.schema.names else [b""] * batch.num_rows
    for raw, packed in zip(text_bytes(batch.column("text")), noted):
        words = words_of(raw)
        mask, _ = automaton.hits(words)
        if packed:
            mask = np.zeros(len(words), dtype=bool) if mask is None else mask
            for start, stop in np.frombuffer(packed, "<i4").reshape(-1, 2).tolist():
                mask[start:stop] = True
        yield raw, mask


def _note(held, spans: str):
    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            found = [b"" if m is None else _ranges(m).astype("<i4").tobytes() for _, m in _all_hits(automaton, batch, spans)]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != spans}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, pa.binary())], [*columns, spans])

    return note


def _cut(held, spans: str, longest: int, coverage: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            keep, texts, changed = [], batch.column("text").to_pylist(), False
            for i, (raw, mask) in enumerate(_all_hits(automaton, batch, spans)):
                if mask is None:
                    keep.append(True)
                    continue
                runs = _ranges(mask).reshape(-1, 2)
                keep.append(bool((runs[:, 1] - runs[:, 0]).max() < longest and mask.mean() <= coverage))
                if keep[-1]:
                    texts[i], changed = _without(raw, runs), True
            if spans in batch.schema.names:
                batch = batch.drop_columns([spans])
            if changed:
                batch = _replace(batch, "text", pa.array(texts, batch.schema.field("text").type))
                if "n_chars" in batch.schema.names:
                    at = batch.schema.get_field_index("n_chars")
                    old = batch.column(at).to_pylist()
                    now = [o if o is None or t is None else len(t) for o, t in zip(old, texts)]
                    batch = _replace(batch, "n_chars", pa.array(now, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return cut


def _without(raw: bytes, runs: np.ndarray) -> str:
    plain = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    starts = np.flatnonzero(plain & ~np.r_[False, plain[:-1]])
    ends = np.r_[starts, len(raw)]
    kept, at = [], 0
    for first, stop in runs.tolist():
        kept.append(raw[at : starts[first]])
        at = int(ends[stop])
    return b"".join([*kept, raw[at:]]).decode()


def _replace(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
