"""Look indicators up in a threat-intelligence feed and note addresses that are not globally routable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..plans.staging import stage
from .bloom import bloom_filter, might_hold, words_for


def latest_entries(feed: DataFrame, order: str = "pos") -> DataFrame:
    """One entry per (category, lower-case value): of duplicates the last one stays."""
    entry = F.struct("confidence", "source", "notes")
    return (
        feed.groupBy("category", F.lower("value").alias("value_lc"))
        .agg(F.max_by(entry, order).alias("e"))
        .select("category", "value_lc", "e.*")
    )


def _number(network: str) -> tuple[int, int]:
    """First and last address of a network, as integers."""
    base, bits = network.split("/")
    first = 0
    for octet in base.split("."):
        first = first * 256 + int(octet)
    return first, first + 2 ** (32 - int(bits)) - 1


def address_number(value: Column) -> Column:
    octets = F.split(value, r"\.")
    number = octets[0].try_cast("bigint")
    for i in (1, 2, 3):
        number = number * 256 + F.get(octets, F.lit(i)).try_cast("bigint")
    return number


def is_private_address(value: Column) -> Column:
    number = address_number(value)

    def within(networks: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for network in networks:
            first, last = _number(network)
            test = test | number.between(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
        return test

    return F.coalesce(within(V.PRIVATE_NETWORKS) & ~within(V.PUBLIC_EXCEPTIONS), F.lit(False))


def _described(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Indicators that met the feed, or nulls in its place, with their verdict and note."""
    hit = F.col("_hit").isNotNull()
    private = (F.col("category") == "ipv4") & is_private_address(F.col("value"))
    notes = (
        F.when(hit, F.coalesce(F.col("notes"), F.lit("")))
        .when(private, V.NOTE_PRIVATE)
        .otherwise(V.NOTE_NO_MATCH)
    )
    return joined.select(
        *columns,
        hit.alias("is_known_malicious"),
        "confidence",
        "source",
        notes.alias("notes"),
    )


def enrich(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Each indicator with what the feed says; one row out per row in. ``feed`` has unique keys.

    A plain left join on the feed's key: Spark broadcasts the feed if its size is within the session's limit, and
    otherwise shuffles both sides, where adaptive execution splits the partition of an indicator found everywhere.
    """
    known = feed.withColumn("_hit", F.lit(True))
    return _described(indicators.join(known, ["category", "value_lc"], "left"), indicators.columns)


def _key() -> Column:
    return F.concat_ws(":", F.col("category"), F.col("value_lc"))


def feed_filter(feed: DataFrame) -> tuple[Column, int]:
    """A Bloom filter of the feed's keys, sized by their number, and its size."""
    words = words_for(feed.count())
    return bloom_filter(_key(), feed, words), words


def maybe_known(indicators: DataFrame, filter_: Column, words: int) -> tuple[DataFrame, DataFrame]:
    """The indicators that the feed may hold, and those it does not."""
    maybe = might_hold(filter_, _key(), words)
    return indicators.where(maybe), indicators.where(~maybe)


def enrich_from_large_feed(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """The rows of :func:`enrich` for a feed beyond the broadcast limit.

    Most indicators are in no feed. A Bloom filter of the feed's keys, built by one aggregate, is asked first; only what
    passes it is shuffled to the feed, everything else gets its note where it is. Indicators are staged, since they are
    read twice and cost more to find than to store.
    """
    found = stage(indicators, "indicators")
    known = stage(feed, "feed")
    maybe, rest = maybe_known(found, *feed_filter(known))
    met = maybe.join(known.withColumn("_hit", F.lit(True)), ["category", "value_lc"], "left")
    nulls = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("confidence", "source", "notes")]
    alone = rest.select("*", F.lit(None).cast("boolean").alias("_hit"), *nulls)
    return _described(met, found.columns).unionByName(_described(alone, found.columns))


def known_malicious(enriched: DataFrame) -> DataFrame:
    return enriched.where("is_known_malicious")
