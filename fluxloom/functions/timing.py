"""Zone-free time arithmetic in whole microseconds, and feed-time parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US


def _epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp.

    Built from the calendar fields: the difference functions cast to a zoned timestamp and
    would be an hour off across a clock change of the session zone.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(t.cast("date")).cast("bigint") * DAY_US
    clock = F.hour(t).cast("bigint") * HOUR_US + F.minute(t).cast("bigint") * MINUTE_US
    return day + clock + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def from_micros(us: Column | str) -> Column:
    """Zone-free timestamp of a microsecond count."""
    return F.timestamp_add("MICROSECOND", F.col(us) if isinstance(us, str) else us, _epoch())


def hours_to_us(hours: float) -> int:
    return int(round(hours * HOUR_US))


def plus_hours(ts: Column | str, hours: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(hours_to_us(hours)), F.col(ts) if isinstance(ts, str) else ts)


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR_US))


# Fixed value: what counts as a time text (seconds, fraction and zone may be missing).
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def parse_utc(text: Column | str) -> Column:
    """Feed time text to a zone-free UTC timestamp; anything unreadable becomes null.

    Offsets are applied, not dropped; text without one counts as UTC whatever the session
    zone. The text is completed to full form first, so one cast reads every layout.
    """
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    full = raw
    for shape, form in (
        (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00"),  # date only
        (r"^(.{16})(?=Z|[+-]|$)", "$1:00"),  # no seconds
        (r"^(.{16}:\d{2}(?:\.\d+)?)$", "$1Z"),  # no zone
        (r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00"),  # offset of hours only
        (r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2"),  # offset without colon
    ):
        full = F.regexp_replace(full, shape, form)
    instant = F.when(raw.rlike(TIME_TEXT), full).try_cast("timestamp")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def as_utc(df, column: str) -> Column:
    """A time column as zone-free timestamp, whether it holds text or a timestamp."""
    kind = dict(df.dtypes)[column]
    return parse_utc(column) if kind == "string" else F.col(column).cast("timestamp_ntz")
