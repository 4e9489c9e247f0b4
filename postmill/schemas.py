"""Schemas of the catalog tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["run_id", "company", "external_job_id"]

LOCATION = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)
LOCATIONS = T.ArrayType(LOCATION)

JOBS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("version_ts", T.TimestampType()),
        T.StructField("company", T.StringType()),
        T.StructField("external_job_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("job_level", T.StringType()),
        T.StructField("details_url", T.StringType()),
        T.StructField("apply_url", T.StringType()),
        T.StructField("locations", LOCATIONS),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("job_description_embedding", T.ArrayType(T.FloatType())),
        T.StructField("posted_ts", T.TimestampType()),
        T.StructField("is_missing_details", T.BooleanType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

DETAILS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("version_ts", T.TimestampType()),
        T.StructField("company", T.StringType()),
        T.StructField("external_job_id", T.StringType()),
        T.StructField("job_description_path", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

COMPANIES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("version_ts", T.TimestampType()),
        T.StructField("company", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

DESCRIPTIONS = T.StructType(
    [
        T.StructField("job_description_path", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

# One row per change of a run's publish state; the current state is a fold of these rows.
RUN_EVENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("version_ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("db_ready", T.BooleanType()),
        T.StructField("db_error_message", T.StringType()),
        T.StructField("es_ready", T.BooleanType()),
        T.StructField("es_error_message", T.StringType()),
    ]
)

POINTERS = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

PAY_RANGE = T.StructType(
    [
        T.StructField("min_amount", T.LongType()),
        T.StructField("max_amount", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("interval", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)
