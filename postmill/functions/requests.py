"""Normalization of request fields, as Columns over a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip
from .titles import CATEGORIES, LEVELS

# Fixed values of the request fields.
ALL = "__all__"
WINDOWS = {"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}
MODES = ("relevance", "recency")


def _whitelist(x: Column, allowed) -> Column:
    value = F.lower(strip(x))
    return F.when(value.isin(list(allowed)), value)


def company_filter(x: Column) -> Column:
    value = F.lower(strip(x))
    return F.when((value != "") & (value != ALL), value)


def location_filter(x: Column) -> Column:
    value = strip(x)
    return F.when((value != "") & (value != ALL), value)


def job_type_filter(x: Column) -> Column:
    return _whitelist(x, CATEGORIES)


def job_level_filter(x: Column) -> Column:
    return _whitelist(x, LEVELS)


def window_filter(x: Column) -> Column:
    return _whitelist(x, WINDOWS)


def search_mode(x: Column) -> Column:
    return F.coalesce(_whitelist(x, MODES), F.lit("relevance"))


def normalize_requests(df: DataFrame) -> DataFrame:
    """Apply the sentinel and whitelist rules to every request field the table has."""
    rules = {
        "company": company_filter,
        "job_type": job_type_filter,
        "job_level": job_level_filter,
        "posted_within": window_filter,
        "country": location_filter,
        "region": location_filter,
        "city": location_filter,
        "search_mode": search_mode,
    }
    return df.withColumns({name: rule(F.col(name)) for name, rule in rules.items() if name in df.columns})
