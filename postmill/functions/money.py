"""Amount, currency and interval Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# --- Fixed values -----------------------------------------------------------------------------
TWO_LETTER_CURRENCY = {"US": "USD", "CA": "CAD", "AU": "AUD", "HK": "HKD", "SG": "SGD"}
SYMBOL_CURRENCY = {"$": "USD", "£": "GBP", "€": "EUR"}
INTERVAL_WORD = {
    "year": "year", "yr": "year", "annual": "year", "annually": "year",
    "month": "month", "mo": "month",
    "week": "week", "wk": "week",
    "day": "day",
    "hour": "hour", "hr": "hour",
}
YEARLY_PHRASES = ["base salary range", "base pay range", "salary range", "annual", "per annum"]
PUBLIC_AMOUNT = r"(?iU)([$£€])?\s*(\d[\d,]*)\s*(?:/\s*([a-z]+))?"
# ----------------------------------------------------------------------------------------------


def lookup(x: Column, mapping: dict[str, str]) -> Column:
    """Value of a fixed mapping, NULL when it lacks the key."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]), x)


def code_currency(code: Column) -> Column:
    """A three-letter code as it is, a known two-letter code by its alias, else NULL."""
    c = F.upper(code)
    return F.when(F.length(c) == 3, c).otherwise(lookup(c, TWO_LETTER_CURRENCY))


def interval_word(text: Column) -> Column:
    """Pay interval named in a lower-case text."""
    unit = F.regexp_extract(text, r"(?U)(?:per|/)\s*(year|month|week|day|hour)\b", 1)
    return (
        F.when(unit != "", unit)
        .when(F.contains(text, F.lit("hourly")), F.lit("hour"))
        .when(text.rlike("|".join(YEARLY_PHRASES)), F.lit("year"))
    )


def public_amount(x: Column) -> Column:
    """(amount, currency, interval) of a text such as ``$100,000/year``."""
    value = F.nullif(strip(x), F.lit(""))
    part = lambda i: F.nullif(F.regexp_extract(value, PUBLIC_AMOUNT, i), F.lit(""))
    unit = F.lower(part(3))
    return F.struct(
        F.replace(part(2), F.lit(","), F.lit("")).try_cast("bigint").alias("amount"),
        lookup(part(1), SYMBOL_CURRENCY).alias("currency"),
        F.coalesce(lookup(unit, INTERVAL_WORD), unit).alias("interval"),
    )
