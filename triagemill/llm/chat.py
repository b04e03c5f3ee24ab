"""Chat formatting: conversations rendered turn by turn from a compiled template, with a loss mask, and read back.

Rows are dealt out and sorted by conversation and turn; each becomes one chunk of the formatted conversation, so a
conversation with a third of all rows is never one string. The chunks of a conversation, in the order of ``part``,
are its formatted text. ``spans`` are the ranges of a chunk, in code points, that the template puts under
``generation``. Reading back parses the chunks in their order and keeps running digests only.

Control strings inside texts get a backslash behind their first character, and one more if there are some already, so
that taking one away gives the text back. In the line that names the role, line ends and backslashes are escaped too.

Defined results: a null role or text is empty; rows with a null ``conv_id`` are one conversation; turns that repeat are
ordered by role, then text, a null turn before all others. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .templates import Template

#: Strings that mark turns for one model or another.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, STOP = CONTROL[:2]
TEMPLATE = (
    "<s>{% for message in messages %}"
    "{{ '<|im_start|>' + (message.role | header) }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}</s>"
)
FORMATTED = "conv_id long, part long, formatted string, spans array<struct<start: int, stop: int>>"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)

_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)({_RESTS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_RESTS})")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(STOP)}\n", re.DOTALL)
_HEADER = re.compile(r"\\(.)")


def escape(text: str | None) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text) if text else ""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def header(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(line: str) -> str:
    return _HEADER.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def compiled(source: str = TEMPLATE) -> Template:
    template = Template(source, {"escape": escape, "header": header})
    if not template.streams:
        raise ValueError("the template must hold one loop over messages and set no names")
    return template


def format_conversations(rows: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """``conv_id, part, formatted, spans``: one chunk for each row of ``rows`` (``conv_id, turn, role, text``)."""
    compiled(source)
    order = ("conv_id", "turn", "role", "text")
    own = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = own.repartition(partitions(rows), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_format(source), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the masked texts, parsed from chunks that stand together and in order."""
    return formatted.mapInArrow(_read, DIGESTS)


def _format(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compiled(source)
        held, part = None, 0
        rows: list[tuple] = []

        def chunk(conv_id, role, text, last: bool) -> tuple:
            pieces = template.turn({"role": role, "text": text})
            pieces = (template.head if part == 0 else []) + pieces + (template.tail if last else [])
            spans, at = [], 0
            for piece, marked in pieces:
                if marked and piece:
                    spans.append({"start": at, "stop": at + len(piece)})
                at += len(piece)
            return conv_id, part, "".join(p for p, _ in pieces), spans

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held is not None:
                    rows.append(chunk(*held, held[0] != row[0]))
                    part = part + 1 if held[0] == row[0] else 0
                held = row
            yield _chunks(rows)
            rows = []
        if held is not None:
            yield _chunks([chunk(*held, True)])

    return run


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), span)
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "formatted", "spans"]
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    held: dict | None = None

    def done(c: dict) -> tuple:
        return c["id"], c["turns"], c["all"].hexdigest(), c["loss_chars"], c["loss"].hexdigest(), c["chars"]

    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "spans"))
        for conv_id, part, formatted, spans in zip(*columns):
            if part == 0:
                if held:
                    rows.append(done(held))
                held = {"id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            held["chars"] += len(formatted)
            for m in _TURN.finditer(formatted):
                held["turns"] += 1
                held["all"].update(f"{unheader(m[1])}\n{unescape(m[2])}\n".encode())
            for span in spans:
                text = unescape(formatted[span["start"] : span["stop"]])
                held["loss_chars"] += len(text)
                held["loss"].update(text.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(held), kinds)], list(names))
