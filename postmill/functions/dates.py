"""Date and epoch Column functions. Timestamps without a zone are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space, optional_string, to_int

# Above these values a number is read as milliseconds.
SEARCH_MILLIS_ABOVE = 1_000_000_000_000
PAYLOAD_MILLIS_ABOVE = 10_000_000_000


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso_epoch(x: Column) -> Column:
    """ISO date or date-time (``Z`` or an offset allowed) to epoch seconds."""
    value = optional_string(x)
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.unix_seconds(value.try_cast("timestamp")))


def month_name_epoch(x: Column) -> Column:
    """``March 1, 2026`` or ``Mar 1, 2026`` to epoch seconds."""
    value = collapse_space(x)
    shaped = value.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$")
    value = F.initcap(value)
    parsed = F.coalesce(
        F.try_to_timestamp(F.when(shaped, value), F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(F.when(shaped, value), F.lit("MMM d, yyyy")),
    )
    return F.unix_seconds(parsed)


def date_epoch(x: Column) -> Column:
    """Any of the accepted date spellings to epoch seconds."""
    return F.coalesce(iso_epoch(x), month_name_epoch(x))


def normalize_epoch(x: Column, millis_above: int) -> Column:
    """Seconds as they are, larger numbers as milliseconds."""
    return F.when(x > millis_above, F.floor(x / F.lit(1000)).cast("bigint")).otherwise(x.cast("bigint"))


def search_epoch(x: Column) -> Column:
    """A stored posting date (number or ISO text, both as text) to epoch seconds."""
    number = optional_string(x).try_cast("double")
    return F.coalesce(normalize_epoch(number, SEARCH_MILLIS_ABOVE), iso_epoch(x))


def any_epoch(x: Column) -> Column:
    """A payload value given as JSON text: number, date text, or an object that holds one."""
    nested = [F.get_json_object(x, f"$.{key}") for key in ("timestamp", "time", "value", "seconds")]
    is_object = F.coalesce(x.startswith("{"), F.lit(False))

    def scalar(v: Column) -> Column:
        return F.coalesce(normalize_epoch(to_int(v), PAYLOAD_MILLIS_ABOVE), date_epoch(v))

    return F.when(is_object, F.coalesce(*[scalar(v) for v in nested])).otherwise(scalar(x))
