"""Key-based merges. A run is immutable once published, so each merge computes the next version of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_strings
from ..schemas import KEY
from .ranking import last_write_wins

# A rule gets the stored and the new value of a column and returns the value to keep for a key on both sides.
Rule = Callable[[Column, Column], Column]


def keep_stored(stored: Column, new: Column) -> Column:
    return stored


def fill_missing(stored: Column, new: Column) -> Column:
    return F.coalesce(stored, new)


def keep_unless_empty(stored: Column, new: Column) -> Column:
    """An empty incoming list leaves the stored list."""
    return F.when(F.coalesce(F.size(new), F.lit(0)) == 0, stored).otherwise(new)


def merge_by_key(
    target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, seq: str | None = None
) -> DataFrame:
    """Insert or overwrite by key (one shuffle per side, on the key).

    Columns without a rule take the new value. Columns the source lacks stay as stored. ``seq`` orders copies of a
    key within the source: the last one wins.
    """
    rules = rules or {}
    if seq is not None:
        source = last_write_wins(source, keys, seq).drop(seq)
    t, s = target.alias("t"), source.alias("s")
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(f"t.{key}") == F.col(f"s.{key}"))
    both = t.withColumn("_t", F.lit(True)).alias("t").join(s.withColumn("_s", F.lit(True)).alias("s"), on, "full_outer")
    in_source = F.col("_s").isNotNull()
    in_both = in_source & F.col("_t").isNotNull()
    out = []
    for name in target.columns:
        if name in keys:
            value = F.coalesce(F.col(f"t.{name}"), F.col(f"s.{name}"))
        elif name not in source.columns:
            value = F.col(f"t.{name}")
        else:
            stored, new = F.col(f"t.{name}"), F.col(f"s.{name}")
            kept = rules[name](stored, new) if name in rules else new
            value = F.when(in_both, kept).when(in_source, new).otherwise(stored)
        out.append(value.alias(name))
    return both.select(out)


def upsert_companies(target: DataFrame, rows: DataFrame) -> DataFrame:
    return merge_by_key(target, rows, ["run_id", "company"])


def upsert_jobs(target: DataFrame, rows: DataFrame, seq: str | None = None) -> DataFrame:
    """New payloads win; stored skills survive an empty list; the missing flag is reset; embeddings are not touched."""
    fresh = rows.drop("job_description_embedding").withColumn("is_missing_details", F.lit(False))
    fresh = fresh.withColumn("skills", clean_strings(F.col("skills")))
    return merge_by_key(target, fresh, KEY, {"skills": keep_unless_empty}, seq)


def upsert_details(target: DataFrame, rows: DataFrame, seq: str | None = None) -> DataFrame:
    return merge_by_key(target, rows, KEY, seq=seq)


def fill_posted_ts(jobs: DataFrame, dated: DataFrame) -> DataFrame:
    """Fill unknown posting dates from a (key, posted_ts) table; known dates stay."""
    found = dated.select(*KEY, F.col("posted_ts").alias("_found")).where(F.col("_found").isNotNull())
    return jobs.join(found, KEY, "left").withColumn("posted_ts", F.coalesce("posted_ts", "_found")).select(jobs.columns)


def mark_missing(jobs: DataFrame, missing: DataFrame) -> DataFrame:
    """Set the flag for keys whose details do not exist upstream."""
    flags = missing.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    return (
        jobs.join(flags, KEY, "left")
        .withColumn("is_missing_details", F.coalesce("_gone", "is_missing_details"))
        .select(jobs.columns)
    )


def apply_features(jobs: DataFrame, features: DataFrame) -> DataFrame:
    """Set skills and embedding of the keys in ``features`` (key, description, skills, embedding).

    A blank description gives an empty list and an empty vector.
    """
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    new = features.select(
        *KEY,
        F.when(blank, F.array().cast("array<string>")).otherwise(clean_strings(F.col("skills"))).alias("_skills"),
        F.when(blank, F.array().cast("array<float>"))
        .otherwise(F.coalesce(F.col("embedding"), F.array()).cast("array<float>"))
        .alias("_embedding"),
    )
    return (
        jobs.join(new, KEY, "left")
        .withColumn("skills", F.coalesce("_skills", "skills"))
        .withColumn("job_description_embedding", F.coalesce("_embedding", "job_description_embedding"))
        .select(jobs.columns)
    )


def carry_forward_details(
    source: DataFrame, target_jobs: DataFrame, target_details: DataFrame, run_id: str, version_ts: Column
) -> DataFrame:
    """Rows to add to the target run: source details of postings it has and whose details it lacks; paths are kept."""
    key = ["company", "external_job_id"]
    return (
        source.select(*key, "job_description_path")
        .join(target_jobs.select(*key), key, "left_semi")
        .join(target_details.select(*key), key, "left_anti")
        .select(
            F.lit(run_id).alias("run_id"), version_ts.alias("version_ts"), *key, "job_description_path",
            version_ts.alias("updated_at"),
        )
    )


def backfill_posted_ts(target_jobs: DataFrame, source_jobs: DataFrame, source_details: DataFrame) -> DataFrame:
    """Fill unknown dates of the target run from the source run's postings that have details."""
    key = ["company", "external_job_id"]
    dated = (
        source_jobs.where(F.col("posted_ts").isNotNull())
        .select(*key, F.col("posted_ts").alias("_found"))
        .join(source_details.select(*key), key, "left_semi")
    )
    return (
        target_jobs.join(dated, key, "left")
        .withColumn("posted_ts", F.coalesce("posted_ts", "_found"))
        .select(target_jobs.columns)
    )


def pending_detail_requests(scraped: DataFrame, details: DataFrame) -> DataFrame:
    """Scraped (company, external_job_id) pairs without details; copies collapse before the join."""
    key = ["company", "external_job_id"]
    # Both sides grow with the run: neither goes through the driver.
    return scraped.select(*key).distinct().join(details.select(*key).hint("merge"), key, "left_anti")
