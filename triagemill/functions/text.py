"""Text helpers that keep Spark's Java regexes in step with the Unicode-aware dialect the patterns are written in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# d: only \n ends a line, so "." crosses \r.  U: \w \d \s \b follow Unicode.  i: case folding beyond ASCII.
UNICODE = "(?dU)"
UNICODE_NO_CASE = "(?idU)"


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends (SQL ``trim`` only removes spaces)."""
    blank = r"[\s\x1c-\x1f]"
    # Possessive, and tried at the start of a run only, so that long runs of blanks cost no more than their length.
    return F.regexp_replace(col, rf"(?U)\A{blank}++|(?<!{blank}){blank}++\z", "")


def capture(col: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern that spans the whole value, as one array, from a single regex pass.

    The value must hold no newline, which makes "\\n" a separator no group can contain. A value that does not
    match comes back as an array of one element.
    """
    return F.split(F.regexp_replace(col, pattern, "\n".join(f"${i}" for i in range(1, groups + 1))), "\n", -1)


def fill(template: str, *cols: Column) -> Column:
    """``format_string`` with a Python-held template."""
    return F.format_string(template, *cols)


def joined(lines: Sequence[Column], sep: str = "\n") -> Column:
    """Join the non-null lines; a null line is left out."""
    return F.concat_ws(sep, *lines)


def ascii_json(literal: Column) -> Column:
    """A JSON literal with every character beyond ASCII as ``\\uXXXX``, those beyond the first plane as two."""

    def unit(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))

    def escaped(c: Column) -> Column:
        point = F.ascii(c)
        rest = point - 0x10000
        pair = F.concat(unit(0xD800 + F.floor(rest / 1024)), unit(0xDC00 + rest % 1024))
        return F.when(point < 128, c).when(point < 0x10000, unit(point)).otherwise(pair)

    beyond = literal.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, F.array_join(F.transform(F.split(literal, ""), escaped), "")).otherwise(literal)


def json_string(col: Column) -> Column:
    """A JSON string literal, quotes and escapes included."""
    return F.regexp_extract(F.to_json(F.array(col)), r"(?s)^\[(.*)\]$", 1)
