"""Event-time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two textual encodings producers use, "2020-08-01 12:00:00.000" and ISO-8601.
SQL_STYLE = r" \d{2}:\d{2}:\d{2}(\.\d{1,9})?"
ISO_STYLE = r"T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?"
EVENT_TIME = rf"^\d{{4}}-\d{{2}}-\d{{2}}({SQL_STYLE}|{ISO_STYLE})$"

# The sink's date and hour parts.
DATE_PART = "yyyy-MM-dd"
HOUR_PART = "HH"


def parse_event_time(text: Column) -> Column:
    """SQL-style or ISO-8601 text to a timestamp; anything else is null.

    The pattern admits the two forms and the cast reads them: no exception is raised per bad row.
    """
    return F.when(text.rlike(EVENT_TIME), text.try_cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def period_start(ts: Column, period_s: Column | int) -> Column:
    """Start of the tumbling period that holds ``ts``; the period may differ per row."""
    step = F.lit(period_s) if isinstance(period_s, int) else period_s
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, step))
