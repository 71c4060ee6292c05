"""Timestamp helpers: lenient parsing, ISO text, epoch nanos, UTC path buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the event model: ISO-8601 UTC with milliseconds, and the
# UTC path layout of stored objects (yyyy/MM/dd/HH and yyyy/MM/dd/HH/mm).
ISO_MS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
HOUR_PATH_FORMAT = "yyyy/MM/dd/HH"
MINUTE_PATH_FORMAT = "yyyy/MM/dd/HH/mm"

# ISO date-time that must carry ``Z`` or an offset ``+HH:MM``; seconds may be left out.
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
ISO_MINUTE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})$"


def _with_seconds(text: Column) -> Column:
    """Minute-precision ISO text with the seconds that Spark's parser wants."""
    return F.regexp_replace(text, ISO_MINUTE, "$1:00$2")


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, ISO_MS_FORMAT)


def to_ms(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)


def lenient_timestamp(text: Column) -> Column:
    """Parse date/time text to a millisecond timestamp; unparsable → NULL."""
    return to_ms(F.try_to_timestamp(_with_seconds(text)))


def strict_iso_ok(text: Column) -> Column:
    """True for an ISO date-time with an explicit zone that really parses."""
    return F.coalesce(text.rlike(ISO_WITH_OFFSET) & F.try_to_timestamp(_with_seconds(text)).isNotNull(), F.lit(False))


def nanos_to_timestamp(nanos_text: Column) -> Column:
    """Integer epoch nanoseconds (as text) → millisecond timestamp; junk → NULL."""
    n = F.when(nanos_text.rlike(r"^\s*-?\d+\s*$"), F.trim(nanos_text).try_cast("decimal(38,0)"))
    millis = F.floor(n / F.lit(1_000_000))
    return F.timestamp_millis(F.when(F.abs(millis) < F.lit(9_000_000_000_000_000), millis).try_cast("long"))


def hour_path(ts: Column) -> Column:
    return F.date_format(ts, HOUR_PATH_FORMAT)


def minute_path(ts: Column) -> Column:
    return F.date_format(ts, MINUTE_PATH_FORMAT)
