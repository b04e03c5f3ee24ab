"""Time arithmetic on TIMESTAMP_NTZ that never passes through the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, from its date parts."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    ).cast("long")


def ntz_from_epoch(seconds: Column) -> Column:
    """Zone-less timestamp at a whole second, the inverse of :func:`epoch_seconds`."""
    return ntz_literal(datetime(1970, 1, 1)) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )


def ntz_literal(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    """ISO text with a ``T``; whole seconds print without a fraction."""
    return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
