"""Predicates and projections over postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..functions.requests import WINDOWS
from ..functions.text import optional_string
from ..functions.titles import CATEGORIES


def posted_within(window: str, as_of: Column) -> Column:
    """Posted in the window that ends at ``as_of``; unknown dates are out."""
    return F.col("posted_ts") >= as_of - F.expr(WINDOWS[window])


def at_location(country: str | None = None, region: str | None = None, city: str | None = None) -> Column | None:
    """All given parts hold on one and the same location of the posting."""
    wanted = {name: value for name, value in (("country", country), ("region", region), ("city", city)) if value}
    if not wanted:
        return None
    return F.exists(
        "locations", lambda e: reduce(lambda a, b: a & b, [e[name] == value for name, value in wanted.items()])
    )


def filter_condition(
    company: str | None = None,
    job_type: str | None = None,
    job_level: str | None = None,
    posted: str | None = None,
    country: str | None = None,
    region: str | None = None,
    city: str | None = None,
    as_of: Column | None = None,
) -> Column:
    conditions = [F.col(name) == value for name, value in
                  (("company", company), ("job_type", job_type), ("job_level", job_level)) if value]
    if posted:
        conditions.append(posted_within(posted, as_of if as_of is not None else F.current_timestamp()))
    location = at_location(country, region, city)
    if location is not None:
        conditions.append(location)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def apply_filters(docs: DataFrame, **filters) -> DataFrame:
    """Conjunction of the optional request filters; simple terms reach the Parquet scan."""
    return docs.where(filter_condition(**filters))


def filter_allowed_categories(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("job_type").isin(list(CATEGORIES)))


def require_ids(postings: DataFrame, column: str = "external_job_id") -> DataFrame:
    """Fail the job when a posting has no id."""
    value = optional_string(F.col(column).cast("string"))
    return postings.withColumn(
        column, F.when(value.isNull(), F.raise_error(F.lit("posting without an id"))).otherwise(value)
    )


def has_description() -> Column:
    """Details were found and point at a description."""
    path = F.col("job_description_path")
    return ~F.col("is_missing_details") & path.isNotNull() & (F.trim(path) != "")


def to_rows(docs: DataFrame) -> DataFrame:
    """Result rows of the API: blanks as NULL, ``region`` as ``state``, empty locations dropped, epoch dates."""
    blank = F.lit("")
    locations = F.filter(
        F.transform(
            "locations",
            lambda e: F.struct(
                F.coalesce(e["city"], blank).alias("city"),
                F.coalesce(e["region"], blank).alias("state"),
                F.coalesce(e["country"], blank).alias("country"),
            ),
        ),
        lambda e: F.concat(e["city"], e["state"], e["country"]) != "",
    )
    text = lambda name: F.nullif(F.col(name), blank)
    return docs.select(
        F.coalesce("external_job_id", blank).alias("id"),
        text("run_id").alias("run_id"),
        text("title").alias("name"),
        text("company").alias("company"),
        text("job_level").alias("job_level"),
        locations.alias("locations"),
        epoch_seconds(F.col("posted_ts")).alias("posted_ts"),
        text("apply_url").alias("apply_url"),
        text("details_url").alias("details_url"),
    )
