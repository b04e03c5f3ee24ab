"""Substring sweep over any text: of a short keyword list as configuration, or of a keyword table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pin import pin
from ..plans.staging import stage
from .gram_index import candidates, held, is_key

#: More keywords than this are a table to join with (``sweep_table``), not configuration.
MOST_KEYWORDS = 10_000


def load_keywords(keywords: DataFrame, most: int = MOST_KEYWORDS) -> list[str]:
    """The list of a keyword table ``(ord, keyword)`` as configuration: in order, at most ``most``, none null."""
    rows = keywords.where(F.col("keyword").isNotNull()).orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keywords")
    return [r.keyword for r in rows]


def keyword_sweep(docs: DataFrame, keywords: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """``(key, ord, keyword)`` for each keyword the lower-cased text holds, an empty keyword included.

    The list is configuration: each keyword becomes one literal ``contains`` on a text that is lower-cased once.
    """
    lowered = pin(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_lower", F.lower("_text"))
    found = F.array_compact(
        F.array(
            *(
                F.when(
                    F.contains("_lower", F.lit(k)), F.struct(F.lit(i).alias("ord"), F.lit(k).alias("keyword"))
                )
                for i, k in enumerate(keywords)
            )
        )
    )
    return lowered.select(key, F.explode(found).alias("k")).select(key, "k.ord", "k.keyword")


def sweep_table(docs: DataFrame, keywords: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of :func:`keyword_sweep` for a keyword table ``(ord, keyword)`` of any size.

    Lower-cased texts are staged once. A keyword of a few bytes is a key of the index (see ``gram_index``), so a
    join finds all that hold it. For longer ones the index on their rarest bytes proposes pairs, and ``contains``
    decides them. A null text counts as empty, a null keyword is left out. Rows of ``docs`` and of ``keywords`` that
    repeat, or that share a key, each give rows of their own.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"),
        F.col(key).alias("_key"),
        F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    rows = stage(rows, "sweep-texts")
    listed = stage(keywords.where(F.col("keyword").isNotNull()).select("ord", "keyword"), "sweep-keywords")
    short, longer = listed.where(is_key("keyword")), listed.where(~is_key("keyword"))
    runs = held(
        rows.select(F.struct("id", "_key").alias("id"), "text"), short.select("ord", F.col("keyword").alias("part"))
    )
    found = runs.select(F.col("id._key").alias(key), "ord", F.col("part").alias("keyword"))
    if longer.isEmpty():
        return found
    literals = longer.select(F.col("keyword").alias("entry"), F.lit("").alias("space"), F.col("keyword").alias("part"))
    pairs = candidates(rows.select("id", F.lit("").alias("space"), "text"), literals.distinct())
    met = rows.join(pairs, "id").where(F.contains(F.col("text"), F.col("entry")))
    proved = met.select(F.col("_key").alias(key), "entry").join(longer, F.col("entry") == F.col("keyword"))
    return found.unionByName(proved.select(key, "ord", "keyword"))
