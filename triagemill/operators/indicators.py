"""Indicators of compromise in free text.

Everything about one text happens inside its row: refang, match, first occurrence, context, order. No shuffle is
needed, and a text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.pin import pin
from ..functions.text import UNICODE, UNICODE_NO_CASE, strip


def refang(col: Column) -> Column:
    for defanged, fanged in V.DEFANGED:
        col = F.replace(col, F.lit(defanged), F.lit(fanged))
    return col


def _hex_category(value: Column) -> Column:
    length = F.length(value)
    result = None
    for size, name in V.HEX_CATEGORY.items():
        result = F.when(length == size, name) if result is None else result.when(length == size, name)
    return result


def _is_address(value: Column) -> Column:
    """ASCII digits only and no octet with a leading zero."""
    return value.rlike(r"^[0-9.]+$") & ~value.rlike(r"\b0\d")


def _is_known_domain(value: Column) -> Column:
    lower = F.lower(value)
    return ~lower.isin(*V.DOMAIN_STOP_LIST) & F.substring_index(lower, ".", -1).isin(*V.TOP_LEVEL_DOMAINS)


# A domain is dotted labels and an alphabetic ending. Written that way, the regex engine recurses once per label and a
# long dotted run overflows its stack. The labels of a run are fixed by its dots, so they can be taken possessively,
# in a loop; if no ending follows them, the domain ends at the last label that starts with one.
DOMAIN_RUN = rf"\b(?:{V.DOMAIN_LABEL}\.(?=[a-zA-Z0-9]))++(?:{V.DOMAIN_ENDING})?"


# All starts in a run of local characters share what follows the run, so only the first word boundary of a run (or of
# what the match before left of one) is worth a try. The characters before that boundary are group 1.
EMAIL_RUN = rf"(?:\G|(?<!{V.EMAIL_LOCAL}))((?>{V.EMAIL_LOCAL}*?\b))({V.EMAIL_LOCAL}++@{V.EMAIL_HOST})"


def _domain_of_run(run: Column) -> Column:
    """The domain in a match of ``DOMAIN_RUN``, or an empty string."""
    return F.when(F.endswith(run, F.lit(".")), F.regexp_extract(run, rf"^(.*\.{V.DOMAIN_ENDING})", 1)).otherwise(run)


@dataclass(frozen=True)
class _Search:
    """One pass over the text.

    ``literal`` stands in every match, so texts without it are not searched; with ``skips`` the match is group 2 and
    group 1 is passed over; ``value`` narrows a match to the indicator; ``test`` drops indicators.
    """

    pattern: str
    category: Callable[[Column], Column]
    literal: str | None = None
    skips: bool = False
    value: Callable[[Column], Column] | None = None
    test: Callable[[Column], Column] | None = None


def _named(category: str) -> Callable[[Column], Column]:
    return lambda value: F.lit(category)


_SEARCHES = {
    "url": _Search(UNICODE_NO_CASE + V.URL_PATTERN, _named("url"), "://"),
    "email": _Search(UNICODE + EMAIL_RUN, _named("email"), "@", skips=True),
    "hex": _Search(UNICODE + V.HEX_PATTERN, _hex_category),
    "cve": _Search(UNICODE_NO_CASE + V.CVE_PATTERN, _named("cve"), "-"),
    "ipv4": _Search(UNICODE + V.IPV4_PATTERN, _named("ipv4"), ".", test=_is_address),
    "domain": _Search(UNICODE + DOMAIN_RUN, _named("domain"), ".", value=_domain_of_run, test=_is_known_domain),
}


def _search_of(category: str) -> str:
    return "hex" if category in V.HEX_CATEGORY.values() else category


def _strings() -> Column:
    return F.array().cast("array<string>")


def _possible(text: Column, search: _Search) -> Column:
    return F.contains(text, F.lit(search.literal)) if search.literal else F.lit(True)


def _entry(search: _Search, value: Column, nth: Column, context: Column) -> Column:
    return F.struct(
        search.category(value).alias("category"),
        F.lower(value).alias("value_lc"),
        nth.cast("int").alias("nth"),
        value.alias("value"),
        context.alias("context"),
    )


def _tested(search: _Search, entries: Column) -> Column:
    return F.filter(entries, lambda e: search.test(e["value"])) if search.test else entries


def _values(text: Column, search: _Search) -> Column:
    """The matches of one search, in order, without context."""
    values = F.when(
        _possible(text, search), F.regexp_extract_all(text, F.lit(search.pattern), F.lit(2 if search.skips else 0))
    ).otherwise(_strings())
    if search.value:
        values = F.transform(values, search.value)
    return _tested(search, F.transform(values, lambda v, i: _entry(search, v, i, F.lit(None).cast("string"))))


# Marks around a match: code points set aside by Unicode for internal use, never for interchange.
OPEN, CLOSE, STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2"


def _unmarked(col: Column) -> Column:
    return F.replace(col, F.lit(CLOSE), F.lit(""))


def _cut(text: Column, search: _Search) -> Column:
    """The text cut before each match, the end of a match marked; the first piece is what precedes all matches."""
    marked = F.regexp_replace(
        text, search.pattern, f"$1{OPEN}$2{CLOSE}" if search.skips else f"{OPEN}$0{CLOSE}"
    )
    return F.when(_possible(text, search), F.split(marked, OPEN, -1)).otherwise(_strings())


def _values_in_context(pieces: Column, search: _Search) -> Column:
    """The matches of one search with what stands around them.

    The context is taken from the pieces next to a match. As each holds a character at least, as many pieces as the
    radius always do, and one is mostly enough.
    """
    radius = V.CONTEXT_RADIUS

    def near(start: Column, length: Column) -> Column:
        return _unmarked(F.array_join(F.slice(pieces, start, length), ""))

    def found(piece: Column, i: Column) -> Column:
        match = F.substring_index(piece, CLOSE, 1)
        return F.when(
            i > 0,
            F.struct(
                i.alias("i"), _unmarked(piece).alias("piece"), (search.value(match) if search.value else match).alias("value")
            ),
        )

    def entry(match: Column, nth: Column) -> Column:
        i, value = match["i"], match["value"]
        last = _unmarked(F.get(pieces, i - 1))
        before = F.when(F.length(last) >= radius, last).otherwise(
            near(F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)))
        )
        rest = F.substr(match["piece"], F.length(value) + 1)
        after = F.when(F.length(rest) >= radius, rest).otherwise(F.concat(rest, near(i + 2, F.lit(radius))))
        around = F.concat(F.right(before, F.lit(radius)), value, F.left(after, F.lit(radius)))
        return _entry(search, value, nth, strip(F.replace(around, F.lit("\n"), F.lit(" "))))

    return F.transform(_tested(search, F.array_compact(F.transform(pieces, found))), entry)


def with_indicators(
    alerts: DataFrame,
    text: str = "text",
    categories: Iterable[str] = V.CATEGORIES,
    context: bool = True,
    out: str = "indicators",
) -> DataFrame:
    """Add the distinct indicators of each text as one array, sorted by (category, lower-case value).

    Of several spellings and places the first occurrence stays. The array is bounded by the text it comes from.
    """
    wanted = list(categories)
    searches = list(dict.fromkeys(_search_of(c) for c in wanted))
    searched = refang(F.coalesce(F.col(text), F.lit("")))
    if context:
        # The marks may not stand in the text that is searched; another such code point matches just the same.
        for mark in (OPEN, CLOSE):
            searched = F.replace(searched, F.lit(mark), F.lit(STAND_IN))
        rows = pin(alerts, "_searched", searched)
        rows = pin(rows, "_cut", F.struct(*(_cut(F.col("_searched"), _SEARCHES[s]).alias(s) for s in searches)))
        found = [_values_in_context(F.col("_cut")[s], _SEARCHES[s]) for s in searches]
    else:
        rows = pin(alerts, "_searched", searched)
        found = [_values(F.col("_searched"), _SEARCHES[s]) for s in searches]
    listed = F.concat(*found)
    if set(wanted) != set(V.CATEGORIES):
        listed = F.filter(listed, lambda e: e["category"].isin(*wanted))
    rows = pin(rows, "_found", F.sort_array(listed)).drop("_searched", "_cut")

    def is_first(entry: Column, i: Column) -> Column:
        previous = F.get(F.col("_found"), i - 1)
        return (
            (i == 0)
            | (previous["category"] != entry["category"])
            | (previous["value_lc"] != entry["value_lc"])
        )

    return pin(rows, out, F.filter("_found", is_first)).drop("_found")


def extract_indicators(
    alerts: DataFrame,
    key: str = "alert_id",
    text: str = "text",
    categories: Iterable[str] = V.CATEGORIES,
    context: bool = True,
) -> DataFrame:
    """One row per distinct indicator of a text: ``(key, category, value, value_lc, context)``."""
    rows = with_indicators(alerts.select(key, text), text, categories, context)
    columns = ["category", "value", "value_lc"] + (["context"] if context else [])
    return rows.select(key, F.explode("indicators").alias("i")).select(key, *(F.col(f"i.{c}") for c in columns))
