"""Points in time as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    """Microseconds since 1970 on the clock that a time shows, with or without a zone; no session zone comes in, so summer time doesn't either."""
    second = F.extract(F.lit("SECOND"), at).cast("decimal(8,6)") * 1_000_000
    minutes = F.unix_date(at.cast("date")).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)
    return minutes * 60_000_000 + second.cast("long")


def cursor_micros(text: Column) -> Column:
    """An RFC 3339 time as microseconds since 1970, or null."""
    return F.unix_micros(F.try_to_timestamp(text))


def cursor_text(value: Column) -> Column:
    """Microseconds since 1970 as an RFC 3339 time in UTC."""
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(value).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
