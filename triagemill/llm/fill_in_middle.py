"""Fill-in-the-middle transformation by counted quantifiers.

``regexp_count`` gives the number n of code points of a text, first in strides of ``STRIDE`` code points and then one by
one over the rest, so that a long text never becomes an array with an entry per code point. Two cuts a <= b follow from
the hash of the id. A pattern made for the row, with a possessive group ``unit{a}``, a possessive group ``unit{b-a}``
and a group for the rest, captures prefix, middle and suffix in one match, and the replacement of that match puts them
together in their new order between the markers. Everything is built-in Spark functions: one scan, no shuffle.

Rows are independent: equal texts with equal ids are cut alike, and a long or frequent text costs only its own length.

Defined results: a null text counts as empty, and an empty text is plain. A null id counts as the empty string where it
is hashed. A text that holds a marker is plain, so a form is always told from ``form`` and markers alone. Rows that
repeat give rows that repeat; an empty table gives none. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pin import pin

#: A code point, line ends included.
UNIT = "(?s)."
STRIDE = 4096


@dataclass(frozen=True)
class Shape:
    """Markers, the seed of the cuts, and how many texts of a hundred stay plain or get the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    plain_percent: int = 10
    suffix_first_percent: int = 20

    def __post_init__(self):
        # No marker may start inside another one or across its border with a text, or forms could not be read back.
        for marker in (self.prefix, self.suffix, self.middle):
            if len(marker) < 2 or marker[0] in marker[1:] or any(marker[0] in m[1:] for m in self._markers()):
                raise ValueError(f"the first character of a marker may stand nowhere else in a marker: {marker!r}")
        if len(set(self._markers())) < 3:
            raise ValueError("three different markers are needed")

    def _markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def code_points(text: Column, stride: int = STRIDE) -> Column:
    """The number of code points: whole strides, then what is left behind the last of them."""
    strides = F.regexp_count(text, F.lit(f"(?s).{{{stride}}}+"))
    rest = F.regexp_replace(text, rf"(?s)\A(?:.{{{stride}}}+)++", "")
    return strides.cast("long") * stride + F.regexp_count(rest, F.lit(UNIT))


def _hashes(seed: str) -> Column:
    """Four unsigned numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def _quoted(literal: str) -> str:
    """A literal as part of a Java pattern."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in literal)


def _replacement(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def fill_in_middle(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of each row; ``text`` with null as empty.

    ``form`` is plain, psm or spm; the numbers of characters are null if it is plain.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = pin(pin(own, "n", code_points(F.col("text"))), "_h", _hashes(shape.seed))
    cuts = [F.col("_h")[i] % (F.col("n") + 1) for i in (0, 1)]
    held = [F.contains("text", F.lit(marker)) for marker in shape._markers()]
    plain = (F.col("n") == 0) | held[0] | held[1] | held[2] | (F.col("_h")[2] % 100 >= 100 - shape.plain_percent)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < shape.suffix_first_percent, "spm").otherwise("psm")
    placed = pin(
        counted, "_p", F.struct(F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"), form.alias("form"))
    ).select("doc_id", "text", "n", "_p.*")
    middle = F.col("b") - F.col("a")
    pattern = F.format_string(r"(?s)\A(.{%d}+)(.{%d}+)(.*+)\z", "a", middle)
    p, s, m = map(_replacement, shape._markers())
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    cut = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    shown = F.col("form") != "plain"
    return pin(placed, "output", cut).select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(shown, F.col("a")).alias("prefix_chars"),
        F.when(shown, middle).alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column, shape: Shape = Shape()) -> Column:
    """The text from an output and its form; no text that was cut holds a marker, so the first of each is the border."""
    p, s, m = map(_quoted, shape._markers())
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
