"""Run checks: counts per company and the violations they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY


def zero_filled(companies: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per configured company; 0 where there is nothing, other companies ignored."""
    names = [name for name in counts.columns if name != "company"]
    return companies.select("company").distinct().join(counts, "company", "left").na.fill(0, names)


def jobs_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company").agg(
        F.count_if(~F.col("is_missing_details")).alias("jobs"),
        F.count_if(F.col("is_missing_details")).alias("missing_details"),
    )


def details_counts(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Details of postings that are not marked missing: all, without a path, with a path but no embedding."""
    path = F.trim(F.coalesce("job_description_path", F.lit("")))
    empty = F.coalesce(F.size("job_description_embedding"), F.lit(0)) == 0
    joined = (
        jobs.where(~F.col("is_missing_details"))
        .select(*KEY, empty.alias("_no_vector"))
        .join(details.select(*KEY, (path == "").alias("_no_path")).hint("merge"), KEY)
    )
    return joined.groupBy("company").agg(
        F.count("*").alias("details"),
        F.count_if("_no_path").alias("missing_description"),
        F.count_if(~F.col("_no_path") & F.col("_no_vector")).alias("missing_embedding"),
    )


def expected_counts(scraped: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct scraped ids and detail requests per company."""
    ids = scraped.select("company", "external_job_id").distinct().groupBy("company").agg(
        F.count("*").alias("expected_jobs")
    )
    wanted = requests.groupBy("company").agg(F.count("*").alias("expected_details"))
    return ids.join(wanted, "company", "full_outer").na.fill(0)


def consistency_counts(companies: DataFrame, scraped: DataFrame, requests: DataFrame, jobs: DataFrame,
                       details: DataFrame) -> DataFrame:
    counts = (
        zero_filled(companies, expected_counts(scraped, requests))
        .join(jobs_counts(jobs), "company", "left")
        .join(details_counts(jobs, details), "company", "left")
    )
    return counts.na.fill(0)


def _rule(condition: Column, position: int, message: Column) -> Column:
    return F.when(condition, F.struct(F.lit(position).alias("rule"), message.alias("message")))


def violations(counts: DataFrame, mode: str = "documented") -> DataFrame:
    """Broken rules per company, with the run if the counts have one.

    Rule 2 compares the details with the postings that should have some. ``mode="requests_only"`` compares them with
    this run's own requests instead, which no run with carried-forward details can meet.
    """
    zero = F.lit(0)
    missing = F.col("missing_details")
    want_jobs = F.greatest(F.col("expected_jobs") - missing, zero)
    want_details = F.greatest(F.col("expected_details") - missing, zero) if mode == "requests_only" else F.col("jobs")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    company = F.col("company")
    rules = [
        _rule(F.col("jobs") != want_jobs, 1,
              text("company=", company, " rule=jobs_expected_mismatch expected=", want_jobs, " actual=", F.col("jobs"),
                   " missing_details=", missing)),
        _rule(F.col("details") != want_details, 2,
              text("company=", company, " rule=details_count_mismatch expected=", want_details, " actual=",
                   F.col("details"), " expected_detail_jobs=", F.col("expected_details"), " missing_details=", missing)),
        _rule(F.col("missing_description") > 0, 3,
              text("company=", company, " rule=missing_job_description count=", F.col("missing_description"))),
        _rule(F.col("missing_embedding") > 0, 4,
              text("company=", company, " rule=missing_job_description_embedding count=", F.col("missing_embedding"))),
    ]
    keys = [name for name in ("run_id", "company") if name in counts.columns]
    found = counts.select(*keys, F.explode(F.array(*rules)).alias("v")).where(F.col("v").isNotNull())
    return found.select(*keys, "v.rule", "v.message")


def failure_message(broken: DataFrame, order: list[str], n: int = 10, separator: str = " | ") -> DataFrame:
    """The first ``n`` messages in ``order``, joined; the list that is sorted holds ``n`` rows only."""
    first = broken.orderBy(*order).limit(n)
    rows = F.sort_array(F.collect_list(F.struct(*order, "message")))
    return first.agg(F.array_join(F.transform(rows, lambda r: r["message"]), separator).alias("message"))


def readiness(states: DataFrame, broken: DataFrame) -> DataFrame:
    """A run may be published when its tables and index are ready and none of its rules is broken.

    ``broken`` names the run of each violation; one without a run blocks nothing.
    """
    blocked = broken.select("run_id").where(F.col("run_id").isNotNull()).distinct().withColumn("_broken", F.lit(True))
    ready = F.coalesce(F.col("db_ready") & F.col("es_ready"), F.lit(False))
    return states.join(blocked, "run_id", "left").withColumn("publishable", ready & F.col("_broken").isNull()).drop("_broken")


def error_rollup(*outcomes: DataFrame, n: int = 5) -> DataFrame:
    """Status of a run from task outcomes (seq, success, error): failed when an unsuccessful one has an error.

    The message holds the first ``n`` errors, in the order of the given tables and then of ``seq``.
    """
    stacked = None
    for position, part in enumerate(outcomes):
        part = part.select(F.lit(position).alias("part"), "seq", "success", "error")
        stacked = part if stacked is None else stacked.unionByName(part)
    errors = stacked.where(
        ~F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce(F.col("error"), F.lit("")) != "")
    ).select("part", "seq", F.col("error").alias("message"))
    count = errors.agg(F.count("*").alias("error_count"))
    message = failure_message(errors, ["part", "seq"], n)
    both = (
        count.unionByName(message, allowMissingColumns=True)
        .agg(F.max("error_count").alias("error_count"), F.max("message").alias("message"))
    )
    failed = F.col("error_count") > 0
    return both.select(
        F.when(failed, "failed").otherwise("in_progress").alias("status"),
        (~failed).alias("db_ready"),
        F.when(failed, F.col("message")).alias("db_error_message"),
        "error_count",
    )


def run_state(events: DataFrame) -> DataFrame:
    """Current publish state of each run, folded from its append-only events.

    A ``start`` event resets the run; only events since the last start count. ``created_at`` is the first start.
    Every field is the value of the latest event that sets it, so the fold is a partial aggregation. ``published`` stands
    for index and tables published and the run succeeded, all at once.
    """
    starts = events.where(F.col("kind") == "start").groupBy("run_id").agg(
        F.max("seq").alias("_start"), F.min("at").alias("created_at")
    )
    live = events.join(starts, "run_id").where(F.col("seq") >= F.col("_start"))
    latest = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    kind = F.col("kind")
    is_set = lambda name: F.col(name).isNotNull()
    db_event, es_event = kind.isin("db"), kind.isin("es")
    return live.groupBy("run_id").agg(
        latest(F.col("version_ts"), kind == "start").alias("version_ts"),
        latest(
            F.when(kind == "start", F.lit("in_progress")).when(kind.isin("succeeded", "published"), F.lit("succeeded"))
            .otherwise(F.col("status")),
            kind.isin("start", "succeeded", "published") | is_set("status"),
        ).alias("status"),
        F.coalesce(latest(F.col("db_ready"), db_event & is_set("db_ready")), F.lit(False)).alias("db_ready"),
        F.max(F.when(kind.isin("db_published", "published"), F.col("at"))).alias("db_published_at"),
        latest(F.col("db_error_message"), db_event).alias("db_error_message"),
        F.coalesce(latest(F.col("es_ready"), es_event & is_set("es_ready")), F.lit(False)).alias("es_ready"),
        F.max(F.when(kind.isin("es_published", "published"), F.col("at"))).alias("es_published_at"),
        latest(F.col("es_error_message"), es_event).alias("es_error_message"),
        F.min("created_at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )


def active_run(pointers: DataFrame, states: DataFrame, namespace: str | None = "jobs_catalog") -> DataFrame:
    """The published run of a namespace (of each, if None) whose tables are ready: newest pointer and run state."""
    current = (
        (pointers.where(F.col("namespace") == namespace) if namespace else pointers)
        .groupBy("namespace")
        .agg(F.max_by("run_id", "updated_at").alias("run_id"), F.max("updated_at").alias("updated_at"))
    )
    return current.join(states.where(F.col("db_ready")).select("run_id", "version_ts", "status"), "run_id")
