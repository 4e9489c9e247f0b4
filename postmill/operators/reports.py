"""Operational reports over run, task and attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_percentiles, top_per_group

STATES = ["scheduled", "running", "queued", "failed", "success", "skipped"]


def table_counts(run_id: str | None = None, **tables: DataFrame) -> DataFrame:
    """Row counts of the tables, of one run or of all."""
    stacked = None
    for name, df in tables.items():
        df = df.where(F.col("run_id") == run_id) if run_id else df
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("queued_at").desc_nulls_last(), F.col("run_id").desc()).limit(n)


def task_state_summary(tasks: DataFrame, now: Column, runs: DataFrame | None = None) -> DataFrame:
    """State counts, derived status, start, end and duration per (dag, run, task); ``runs`` keeps listed runs only."""
    if runs is not None:
        tasks = tasks.join(runs.select("run_id"), "run_id", "left_semi")
    agg = tasks.groupBy("dag_id", "run_id", "task_id").agg(
        *[F.count_if(F.col("state") == state).alias(state) for state in STATES],
        F.min("start_date").alias("started"),
        F.max("end_date").alias("ended"),
    )
    has = {state: F.col(state) > 0 for state in STATES}
    open_ = has["running"] | has["queued"] | has["scheduled"]
    idle = ~(open_ | has["failed"] | has["success"] | has["skipped"])
    status = (
        F.when(has["running"], "running")
        .when(has["queued"], "queued")
        .when(has["scheduled"], "scheduled")
        .when(has["failed"] & ~has["success"] & ~has["skipped"], "failed")
        .when(has["success"] & ~has["failed"], "success")
        .when(has["skipped"] & ~has["failed"], "skipped")
        .when(idle, "pending")
        .otherwise("mixed")
    )
    elapsed = F.unix_micros(F.coalesce("ended", now)) - F.unix_micros("started")
    return agg.select(
        "dag_id", "run_id", "task_id", status.alias("status"),
        F.when(~idle, F.col("started")).alias("task_start_time"),
        F.when(~idle, F.col("ended")).alias("task_end_time"),
        F.when(~idle, F.round(elapsed / F.lit(1_000_000)).cast("bigint")).alias("duration_s"),
        *STATES,
    ).orderBy("dag_id", F.col("run_id").desc(), F.col("task_start_time").asc_nulls_last(), "task_id")


def failed_runs(states: DataFrame, limit: int, run_id: str | None = None) -> DataFrame:
    failed = states.where(F.col("status") == "failed")
    if run_id:
        failed = failed.where(F.col("run_id") == run_id)
    return failed.orderBy(F.col("updated_at").desc()).limit(limit)


def top_failure_causes(attempts: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` most common causes of failed attempts as ``cause (xN)``; on a tie the one seen first."""
    causes = (
        attempts.where(~F.col("success"))
        .withColumn("cause", F.trim("error_cause"))
        .where(F.col("cause") != "")
        .groupBy(*keys, "cause")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    )
    best = top_per_group(causes, keys, [F.col("n").desc(), F.col("first_seq").asc()], k)
    # At most k rows per key are left here.
    labels = F.sort_array(F.collect_list(F.struct("rn", F.format_string("%s (x%d)", "cause", "n").alias("label"))))
    return best.groupBy(*keys).agg(
        F.array_join(F.transform(labels, lambda c: c["label"]), " | ").alias("top_failure_causes")
    )


def benchmark_summary(attempts: DataFrame) -> DataFrame:
    """Attempts, success rate, mean latency and exact p50/p95 of successes per (config, company, endpoint)."""
    keys = ["config_id", "company", "endpoint"]
    ok = F.col("success")
    totals = attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.round(F.count_if(ok) / F.count("*") * 100, 2).alias("success_rate_pct"),
        F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms_all"),
        F.round(F.avg(F.when(ok, F.col("latency_ms"))), 2).alias("mean_latency_ms_success"),
    )
    points = exact_percentiles(
        attempts.where(ok), keys, "latency_ms", {"p50_latency_ms_success": 0.5, "p95_latency_ms_success": 0.95}
    )
    rounded = points.select(*keys, *[F.round(name, 2).alias(name) for name in points.columns if name not in keys])
    # NULL keys are groups too, so the parts meet on a struct of the keys, which is never NULL.
    group = F.struct(*keys)
    return (
        totals.withColumn("_group", group)
        .join(rounded.withColumn("_group", group).drop(*keys), "_group", "left")
        .join(top_failure_causes(attempts, keys).withColumn("_group", group).drop(*keys), "_group", "left")
        .drop("_group")
        .na.fill("", ["top_failure_causes"])
        .orderBy(*keys)
    )


def rank_configs(summary: DataFrame) -> DataFrame:
    """Configurations by average success rate, then by average p95 (none counts as infinite)."""
    return (
        summary.groupBy("config_id")
        .agg(
            F.avg("success_rate_pct").alias("avg_success_rate_pct"),
            F.coalesce(F.avg("p95_latency_ms_success"), F.lit(float("inf"))).alias("avg_p95_latency_ms"),
        )
        .orderBy(F.col("avg_success_rate_pct").desc(), F.col("avg_p95_latency_ms").asc(), "config_id")
    )


def capacity_check(snapshots: DataFrame, minimum: int) -> DataFrame:
    """Totals, the scopes that have too little available, and whether work may start.

    ``snapshots`` holds (scope, state) rows; scopes are configured, so their list is short.
    """
    scopes = snapshots.groupBy("scope").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("available", "inuse", "blocked")]
    )
    short = F.col("available") < minimum
    return scopes.agg(
        F.coalesce(F.sum("available"), F.lit(0)).alias("total_available"),
        F.coalesce(F.sum("inuse"), F.lit(0)).alias("total_inuse"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("total_blocked"),
        F.array_join(F.sort_array(F.collect_list(F.when(short, F.col("scope")))), ",").alias("shortages"),
        ((F.count("*") > 0) & (F.count_if(short) == 0)).alias("ready"),
    )


def peek(table: DataFrame, n: int, newest: str = "updated_at", text: str | None = None, width: int = 40) -> DataFrame:
    """The latest ``n`` rows; a long text column is cut to ``width`` characters and marked."""
    latest = table.orderBy(F.col(newest).desc()).limit(n)
    if text is None:
        return latest
    value = F.coalesce(F.col(text), F.lit(""))
    short = F.concat(F.substring(value, 1, width), F.lit(" ..."))
    return latest.withColumn(text, F.when(F.length(value) > width, short).otherwise(value))
