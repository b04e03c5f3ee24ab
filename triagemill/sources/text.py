"""Text inputs: log files line by line, alerts whole, keyword lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.staging import stage


def read_syslog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(source_file, seq, value)`` of every line of the files; bytes that are not UTF-8 become U+FFFD.

    Files are split, so no task knows a line's number. ``seq`` orders the lines of a file all the same: by the start
    of the split they were read in, then by the order of reading.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("seq"),
        F.make_valid_utf8("value").alias("value"),
    )


#: Splits whose places are sent to all executors at once, about 32 bytes each; more of them are met in a join.
MOST_SPLITS = 500_000


def read_numbered(spark: SparkSession, path: str | list[str], folders: bool = False) -> DataFrame:
    """``(source_file, seq, value)`` like ``read_syslog``, with ``seq`` the number of the line in its file, from 0.

    With ``folders`` a folder counts as one file: numbers go on from one of its files to the next in the order of names.

    Two passes: the lines of each split are counted, sums over the splits of a file tell how many lines stand before each
    of them, and the place of a line within its split is added. Both passes read the same splits in the same order, since
    they share the plan of the scan. Lines are not shuffled while the splits are at most ``MOST_SPLITS``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.make_valid_utf8("value").alias("value"),
    )
    splits = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    whole = F.regexp_replace("source_file", "/[^/]*$", "") if folders else F.col("source_file")
    before = F.sum("n").over(Window.partitionBy(whole).orderBy("source_file", "block")) - F.col("n")
    starts = stage(splits.select("source_file", "block", (before - F.col("first")).alias("add")), "splits")
    small = starts.count() <= MOST_SPLITS
    met = lines.join(F.broadcast(starts) if small else starts, ["source_file", "block"])
    return met.select(whole.alias("source_file"), (F.col("place") + F.col("add")).alias("seq"), "value")


def read_alerts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(alert_id, text)``: each file is one alert."""
    alerts = spark.read.text(path, wholetext=True)
    return alerts.select(F.col("_metadata.file_path").alias("alert_id"), F.col("value").alias("text"))


def read_alert_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(alert_id, text)`` of alerts kept as JSON objects, one per line: millions of them in files of any size."""
    return spark.read.schema("alert_id STRING, text STRING").json(path)


def read_keywords(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(ord, keyword)``: one keyword per line, trimmed and lower-cased.

    Files are split, so ``ord`` is a struct that orders keywords by file, start of the split, and order of reading.
    """
    lines = spark.read.text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select(place.alias("ord"), keyword(F.col("value")).alias("keyword"))


def keyword(col: Column) -> Column:
    """The form in which a keyword is compared."""
    return F.lower(strip(col))


def read_numbered_keywords(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(source_file, ord, keyword)`` like ``read_keywords``, with ``ord`` the number of the line in its file, from 0."""
    return read_numbered(spark, path).select("source_file", F.col("seq").alias("ord"), keyword(F.col("value")).alias("keyword"))
