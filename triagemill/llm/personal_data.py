"""Personal data behind disguises: normalise, detect, and map the spans back to the source.

Each text is searched twice. The base search runs over the text as it is. For the second search the text becomes a
``Tape``: characters that each know where in the source they come from. Transducers rewrite the tape one after the
other:

- ``plain_characters``: homoglyphs, full-width and mathematical letters, digits of other scripts, odd blanks and dashes
  become ASCII, and invisible characters vanish; by a table over all code points that is built from Unicode's own data;
- ``spelled_digits``: runs of three or more spelled digits ("plus one five double five") become digits;
- ``disguised_addresses``: "at" and "dot" as words or in brackets become "@" and "." where a whole address stands;
- ``disguised_dots``: "dot" between the four numbers of an IP address, and letters that look like digits among digits.

The same detectors then run over the tape, and a span they find there is mapped back to the source characters it came
from. It counts as an addition if a transducer had rewritten something inside it and no base span of its kind holds
it. Base spans always stay. A text on which no transducer fires is not searched again.

All searches take time in proportion to the text: the detectors start at "@", "+" or the start of a run of digits and
never go back over a run. The work is a map over the documents in slices of bounded size; nothing is shuffled.

Defined results: a null text counts as empty and has no spans. Rows that repeat give rows that repeat. Spans that tie in
start and kind are in order of their end. A null id stays null. Columns besides ``doc_id`` and ``text`` are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind: string, start: int, stop: int, base: boolean>"
SLICE_BYTES = 1 << 22

#: (start, end, kind as a number)
Found = tuple[int, int, int]

# --- Detectors -----------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" with what may stand before it, back to the "@" or match before, and a domain behind it."""
    since = 0
    at = text.find("@")
    while at >= 0:
        before = text[since:at]
        name = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if name else None
        if domain:
            yield at - name, domain.end()
        since = domain.end() if domain else at + 1
        at = text.find("@", since)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m.group().split(".")]
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
            yield m.span()


def digits_of(text: str) -> list[int]:
    return [int(c) for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = (sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = digits_of(m.group()) if m.end() - m.start() < 40 else []
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(m.group()) - sum(map(m.group().count, " ().-")) - 1 <= 15:
            yield m.span()


DETECTORS: tuple[Callable[[str], Iterator[tuple[int, int]]], ...] = (emails, addresses, cards, phones)


def detect(text: str) -> list[Found]:
    """All spans of all kinds, by start and kind."""
    return sorted((a, b, k) for k, detector in enumerate(DETECTORS) for a, b in detector(text))


# --- Transducers ---------------------------------------------------------------------------------------------------


class Tape:
    """A text with, for each character, the source characters it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32)
        self.stops = self.starts + np.int32(1)
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the stretches (start, end, new text), which are in order and do not overlap."""
        starts, stops, news = zip(*edits)
        ends = len(self.text)
        self.text = "".join(
            part
            for since, start, new in zip((0, *stops), (*starts, ends), (*news, ""))
            for part in (self.text[since:start], new)
        )
        # Stretches that stay and new ones in turn: where each begins in the old text, and how far it steps on.
        turns = len(edits) * 2 + 1
        first, last, sizes, step = (np.empty(turns, np.int64) for _ in range(4))
        first[::2], first[1::2] = (0, *stops), starts
        last[::2], last[1::2] = first[::2], np.array(stops) - 1
        sizes[::2], sizes[1::2] = np.array((*starts, ends)) - first[::2], [len(new) for new in news]
        step[::2], step[1::2] = 1, 0
        inside = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * np.repeat(step, sizes)
        old = np.repeat(first, sizes) + inside
        self.starts, self.stops = self.starts[old], self.stops[np.repeat(last, sizes) + inside]
        self.changed = self.changed[old] | (np.repeat(step, sizes) == 0)

    def lower(self) -> str:
        """The text in lower case, of the same length: one letter alone becomes two otherwise."""
        return self.text.replace("\u0130", "i").lower()

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.stops[stop - 1])

    def rewritten(self, start: int, stop: int) -> bool:
        """Whether a character of the stretch was replaced, or one inside it has vanished."""
        a, b = self.source(start, stop)
        return b - a != stop - start or bool(self.changed[start:stop].any())


# Letters of other scripts and the Latin letters they are drawn like.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινρυıɑɡ∙․·",
        "ABEKMHOPCTXYIJSaeopcyxijshdqwABEZHIKMNOPTYXaoivpuiag...",
    )
)
_GONE = np.uint32(0x110000)


@cache
def _recoding() -> np.ndarray:
    """For each code point the one it is normalised to; ``_GONE`` for invisible ones."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x80, 0x110000):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co", "Cs", "Lo"):
            continue
        if kind == "Nd":
            table[point] = 48 + unicodedata.decimal(char)
        elif kind == "Cf" or 0xFE00 <= point <= 0xFE0F:
            table[point] = _GONE
        elif kind == "Zs":
            table[point] = 32
        elif kind == "Pd":
            table[point] = 45
        else:
            plain = unicodedata.normalize("NFKC", char)
            plain = _LOOKALIKES.get(plain, plain)
            if len(plain) == 1 and 32 < ord(plain) < 127:
                table[point] = ord(plain)
    return table


def plain_characters(tape: Tape) -> None:
    if tape.text.isascii():
        return
    points = np.frombuffer(tape.text.encode("utf-32-le", "surrogatepass"), np.uint32)
    new = _recoding()[points]
    changed = new != points
    if changed.any():
        kept = new != _GONE
        tape.text = new[kept].tobytes().decode("utf-32-le", "surrogatepass")
        tape.starts, tape.stops = tape.starts[kept], tape.stops[kept]
        tape.changed = changed[kept]


# Spelled digits in four languages.
_DIGIT_WORDS = {
    word: str(digit)
    for names in (
        "zero one two three four five six seven eight nine",
        "oh", "o",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(names.split())
}
_REPEATS = {"double": 2, "triple": 3}
#: "At the dot ..." is a sentence, no address.
_NO_HOSTS = {*"a an her his its my our that the their this your".split()}
_AT_WORDS = "at|arobase|arroba"
_DOT_WORDS = "dot|point|punkt|punto"

_GAP = r"[ \t,-]{1,2}"
_OPEN, _CLOSE = r"[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,2}"
_DOT = rf"(?:[ \t]{{0,2}}{_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}|[ \t]{{1,3}}(?:{_DOT_WORDS})[ \t]{{1,3}}|_dot_|-dot-)"
#: The first character decides most places, so it is looked at alone; then what stands before it.
_AT = (
    rf"[ \t\[({{<_@-](?<=[a-z0-9].)(?:(?<=@)|(?<=_)at_|(?<=-)at-|(?<=[ \t])[ \t]{{0,2}}(?:{_AT_WORDS}|@)[ \t]{{1,3}}"
    rf"|(?:(?<=[ \t])[ \t]?[\[({{<]|(?<=[\[({{<]))[ \t]{{0,2}}(?:{_AT_WORDS}|@){_CLOSE})"
)
_BY_LETTER = {c: [w[1:] for w in _DIGIT_WORDS if w[0] == c] for c in sorted({w[0] for w in _DIGIT_WORDS})}
_WORD = "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(ends, key=len, reverse=True))})" for c, ends in _BY_LETTER.items()) + ")"
_SPELLED = rf"(?:(?:{'|'.join(_REPEATS)})[ -])?{_WORD}\b"
_RUN = re.compile(rf"\b(?:plus{_GAP})?{_SPELLED}(?:(?:{_GAP}|{_DOT}|\.){_SPELLED}){{2,}}+")
_PIECE = re.compile(rf"(?P<plus>plus{_GAP})|(?P<word>{_SPELLED})|(?P<dot>{_DOT}|\.)|(?P<gap>{_GAP})")
#: What every run holds behind its first word.
_PAIR = re.compile(rf"[ \t,.\])}}>_-](?=[{''.join(_BY_LETTER)}]){_WORD}(?:{_GAP}|{_DOT}|\.)(?:{_SPELLED})")
_LABEL = "[a-z0-9-]{1,63}+"
_DISGUISED = re.compile(rf"(?P<at>{_AT})(?P<domain>{_LABEL}(?:(?:\.|{_DOT}){_LABEL})++)")
_DOT_ALONE = re.compile(_DOT)
_NAME_BEFORE = re.compile(rf"(?:[a-z0-9_%+-]++{_DOT})++[a-z0-9_%+-]++\Z")
_WORD_BEFORE = re.compile(r"[a-z0-9._%+-]+\Z")
#: A word that no sentence holds before "at", such as ``name.42``.
_ACCOUNT = re.compile(r"(?=[a-z0-9._+]*[a-z])(?=[a-z0-9._+]*[0-9_+]|[a-z0-9]{2,}\.[a-z0-9]{2})[a-z0-9._+]*[a-z0-9]")
_FOUR = re.compile(rf"[0-9](?<![0-9.].)[0-9]{{0,2}}+(?:(?:\.|{_DOT})[0-9]{{1,3}}+){{3}}(?![0-9])")
_LETTERS_AMONG = re.compile(r"[0-9][ .-]?(?P<letters>[oil]{1,2})(?=[0-9])")
_DIGIT_LETTERS = str.maketrans("oil", "011")
#: How far before an "at" its name is looked for.
_BEFORE = 160


def spelled_digits(tape: Tape) -> list[tuple[int, int]]:
    """Rewrite runs of spelled digits; returns the source spans of runs that are long enough for a phone number."""
    lower = tape.lower()
    if not _PAIR.search(lower):
        return []
    edits: list[tuple[int, int, str]] = []
    long = []
    for run in _RUN.finditer(lower):
        digits, plain = [], True
        for piece in _PIECE.finditer(lower, *run.span()):
            if piece["word"]:
                *repeat, word = re.split("[ -]", piece["word"])
                new = _DIGIT_WORDS[word] * (_REPEATS[repeat[0]] if repeat else 1)
                digits.append(new)
            else:
                plain &= piece["gap"] is not None
                new = "+" if piece["plus"] else "." if piece["dot"] else ""
            edits.append((*piece.span(), new))
        number = "".join(digits)
        counted = all((int(b) - int(a)) % 10 in (0, 1, 9) for a, b in zip(number, number[1:]))
        if plain and 10 <= len(number) <= 15 and not counted:
            long.append(tape.source(*run.span()))
    if edits:
        tape.rewrite(edits)
    return long


def disguised_addresses(tape: Tape) -> None:
    """Rewrite "at" and "dot" of e-mail addresses.

    A plain word before a plain "at" is no account, unless a "dot" in the domain is disguised as well.
    """
    lower, edits = tape.lower(), []
    for m in _DISGUISED.finditer(lower):
        at, start = m["at"], m.start("domain")
        if at.strip(" \t").isalpha() and re.split("[^a-z0-9-]", m["domain"], maxsplit=1)[0] in _NO_HOSTS:
            continue
        dots = [(start + d.start(), start + d.end(), ".") for d in _DOT_ALONE.finditer(m["domain"])]
        if at == "@":
            # A sentence may go on with a word behind a plain address; only marks that no sentence has count there.
            dots = [d for d in dots if lower[d[0] : d[1]].strip(" \t") not in ("point", "punkt", "punto")]
            if not dots:
                continue
        before = lower[max(0, m.start() - _BEFORE) : m.start()]
        name, word = _NAME_BEFORE.search(before), _WORD_BEFORE.search(before)
        if not (dots or name or set(at) & set("[({<@") or word and _ACCOUNT.fullmatch(word.group())):
            continue
        if name:
            first = m.start() - len(before) + name.start()
            edits += [(first + d.start(), first + d.end(), ".") for d in _DOT_ALONE.finditer(name.group())]
        if at != "@":
            edits.append((*m.span("at"), "@"))
        edits += dots
    if edits:
        tape.rewrite(sorted(set(edits)))


def disguised_dots(tape: Tape) -> None:
    """Rewrite the dots of IP addresses, then letters among digits."""
    dots = [
        (m.start() + d.start(), m.start() + d.end(), ".")
        for m in _FOUR.finditer(tape.lower())
        for d in _DOT_ALONE.finditer(m.group())
    ]
    if dots:
        tape.rewrite(dots)
    letters = [(*m.span("letters"), m["letters"].translate(_DIGIT_LETTERS)) for m in _LETTERS_AMONG.finditer(tape.lower())]
    if letters:
        tape.rewrite(letters)


def disguised(text: str, base: list[Found]) -> list[Found]:
    """The spans that only the transducers show, in places of the source."""
    tape = Tape(text)
    plain_characters(tape)
    spelled = spelled_digits(tape)
    disguised_addresses(tape)
    disguised_dots(tape)
    if not tape.changed.any() and len(tape.text) == len(text):
        return []
    found = set()
    for start, stop, kind in detect(tape.text):
        if tape.rewritten(start, stop) and (KINDS[kind] != "email" or re.search(r"\.[A-Za-z]{2,}\Z", tape.text[start:stop])):
            found.add((*tape.source(start, stop), kind))
    covered = [*base, *found]
    found |= {(a, b, 3) for a, b in spelled if not any(x < b and a < y for x, y, _ in covered)}
    return sorted((a, b, k) for a, b, k in found if not any(x <= a and b <= y and k == kind for x, y, kind in base))


# --- The operator --------------------------------------------------------------------------------------------------


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text: kind, start, end and whether the base search found it."""
    base = detect(text or "")
    more = disguised(text or "", base)
    every = sorted([(*x, True) for x in base] + [(*x, False) for x in more], key=lambda x: (x[0], x[2], x[1]))
    return [(KINDS[k], a, b, own) for a, b, k, own in every]


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with a placeholder of the first kind for each stretch of spans that overlap."""
    out, at = [], 0
    for kind, start, stop, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, redacted`` of each row; ends are exclusive, places count code points."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_search, f"doc_id long, spans array<{SPAN}>, redacted string")


def listed(spans: Column) -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
    )
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            found = [spans_of(t) for t in texts]
            rows = [[dict(zip(("kind", "start", "stop", "base"), s)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, kind), pa.array(map(redacted, texts, found), pa.string())],
                ["doc_id", "spans", "redacted"],
            )
