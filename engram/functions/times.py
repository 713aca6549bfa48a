"""Times as text, milliseconds and Julian days. 0 milliseconds is the zero time and stands for no time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of an RFC 3339 time.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"
#: Fixed value: the Julian day at the start of 1970.
EPOCH_DAY = 2440587.5


def rfc3339_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 time with offset; null for text of another form."""
    plain = F.translate(F.upper(text), "T", " ")
    plain = F.regexp_replace(plain, r"(\.\d{6})\d+", "$1")
    at = F.try_to_timestamp(F.regexp_replace(plain, "Z$", "+00:00"))
    return F.when(text.rlike(RFC3339), F.floor(F.unix_micros(at) / 1000))


def ms_rfc3339(ms: Column) -> Column:
    """An RFC 3339 time in UTC; null for 0. Needs a session in UTC."""
    return F.when(ms != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def julian_ms(day: Column) -> Column:
    """Milliseconds since 1970 of a Julian day."""
    return F.round((day - EPOCH_DAY) * 86400000.0).cast("bigint")
