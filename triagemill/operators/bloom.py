"""A Bloom filter of keys: built by one aggregate, asked inside a filter, of a size that does not grow with the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longs of the bit array: 1 MB, which holds a million keys with four false positives in a hundred.
WORDS = 1 << 17
#: The largest array, 16 MB. It holds 16 million keys as well; beyond, more keys pass that are not there, and none is lost.
MOST_WORDS = 1 << 21


def words_for(keys: int) -> int:
    """Longs for so many keys: eight bits or more for each, within the bounds."""
    return min(MOST_WORDS, max(1 << 10, 1 << (keys // 8).bit_length()))


def _places(key: Column, words: int) -> list[Column]:
    """Two bit places of a key, from the two halves of its hash."""
    hashed = F.xxhash64(key)
    return [F.pmod(h, F.lit(64 * words)) for h in (hashed, F.shiftrightunsigned(hashed, 32) + F.lit(0x9E3779B9))]


def bloom_filter(keys: Column, of: DataFrame, words: int = WORDS) -> Column:
    """The filter of all values of ``keys`` in ``of``: a scalar array of ``words`` longs, made once per query.

    Bits are put together by key of the array, so what one task gathers is the array, whatever the number of keys.
    """
    place = of.select(F.explode(F.array(*_places(keys, words))).alias("p"))
    bits = place.select(
        F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits")
    )
    every = of.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    gathered = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    array = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return gathered.agg(array["bits"].alias("bits")).scalar()


def might_hold(filter_: Column, key: Column, words: int = WORDS) -> Column:
    """False only for keys that the filter was not built from."""
    one, two = (
        F.getbit(F.get(filter_, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1
        for place in _places(key, words)
    )
    return one & two
