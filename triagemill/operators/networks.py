"""The most specific network of a table that holds an address, by equi-joins on prefixes instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .bloom import bloom_filter, might_hold, words_for
from .enrich import address_number


def with_prefix(networks: DataFrame, network: str = "network") -> DataFrame:
    """Add ``bits, prefix`` of networks such as ``10.0.0.0/8``; rows that are none go. An address alone has 32 bits."""
    form = r"^([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:/([0-9]{1,2}))?$"
    address = F.regexp_extract(network, form, 1)
    bits = F.coalesce(F.regexp_extract(network, form, 2).try_cast("int"), F.lit(32))
    number = address_number(address)
    octets = F.transform(F.split(address, r"\."), lambda o: o.try_cast("int"))
    valid = (address != "") & (bits <= 32) & F.forall(octets, lambda o: o <= 255)
    own = networks.withColumn("bits", bits).withColumn("prefix", number).where(valid)
    return own.withColumn("prefix", F.expr("shiftrightunsigned(prefix, 32 - bits)"))


def most_specific(rows: DataFrame, networks: DataFrame, address: str = "address", network: str = "network") -> DataFrame:
    """Each row with the columns of the most specific network that holds its address, null if none does.

    ``networks`` may have any number of rows. Distinct addresses give one key per prefix length that the table knows, at
    most 33; a Bloom filter of the table's prefixes removes most of them before the shuffle. Of networks with equal
    prefixes the first in the order of all columns counts. Addresses that are null or not four numbers are in no network.
    """
    columns = networks.columns
    known = with_prefix(networks, network).groupBy("bits", "prefix").agg(F.min(F.struct(*columns)).alias("found"))
    known = stage(known, "networks")
    lengths = sorted(r.bits for r in known.select("bits").distinct().collect())
    prefixes = F.array(
        *(
            F.struct(F.lit(b).alias("bits"), F.shiftrightunsigned(F.col("_number"), 32 - b).alias("prefix"))
            for b in lengths
        )
    )
    distinct = rows.select(F.col(address).alias("_address")).distinct().withColumn("_number", address_number(F.col("_address")))
    asked = distinct.where(F.col("_number").between(0, (1 << 32) - 1))
    if not lengths:
        return rows.select("*", *(F.lit(None).cast(networks.schema[c].dataType).alias(c) for c in columns))
    asked = asked.select("_address", F.explode(prefixes).alias("p")).select("_address", "p.*")
    words = words_for(known.count())
    key = F.struct("bits", "prefix")
    passed = asked.where(might_hold(bloom_filter(key, known, words), key, words))
    best = (
        passed.join(known, ["bits", "prefix"])
        .groupBy("_address")
        .agg(F.max_by("found", "bits").alias("found"))
    )
    met = rows.join(best, F.col(address) == F.col("_address"), "left")
    return met.select(*(rows[c] for c in rows.columns), *(F.col(f"found.{c}").alias(c) for c in columns))
