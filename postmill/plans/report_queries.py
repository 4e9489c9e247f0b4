"""Operational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from . import views as V
from .register import Registry

query = Registry()

NOW = "2024-02-01 00:00:00"


@query(
    "table_counts",
    f"""WITH {V.BASE_SQL}
 SELECT 'jobs' AS table_name, (SELECT count(*) FROM postings) + (SELECT count(*) FROM postings
  WHERE o_orderstatus <> 'O') + (SELECT count(*) FROM pages) AS row_count
 UNION ALL SELECT 'job_details', count(*) FROM run_details""",
)
def table_counts(spark, sf):
    jobs = V.jobs(spark, sf, "r1", places=False).select("run_id").unionByName(
        V.jobs(spark, sf, places=False).select("run_id"))
    details = V.details(spark, sf, "r1").select("run_id").unionByName(V.details(spark, sf).select("run_id"))
    return R.table_counts(jobs=jobs, job_details=details)


@query(
    "table_counts_of_run",
    f"""WITH {V.BASE_SQL}
 SELECT 'jobs' AS table_name, (SELECT count(*) FROM postings WHERE o_orderstatus <> 'O')
  + (SELECT count(*) FROM pages) AS row_count
 UNION ALL SELECT 'job_details', count(*) FROM run_details WHERE run_id = 'r1'""",
)
def table_counts_of_run(spark, sf):
    jobs = V.jobs(spark, sf, "r1", places=False).select("run_id").unionByName(
        V.jobs(spark, sf, places=False).select("run_id"))
    details = V.details(spark, sf, "r1").select("run_id").unionByName(V.details(spark, sf).select("run_id"))
    return R.table_counts("r1", jobs=jobs, job_details=details)


_TASKS_SQL = """
tasks AS (
 SELECT 'crawl' AS dag_id, strftime(ts, '%Y-%m-%d') AS run_id, 'task-' || CAST(user_id AS VARCHAR) AS task_id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success'
   WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'skipped' END AS state,
  CASE WHEN event_type <> 'signup' THEN epoch_us(ts) END AS start_us,
  CASE WHEN event_type NOT IN ('signup', 'view') THEN CAST(floor(epoch_us(ts) / 1000000) + floor(value) AS BIGINT)
   * 1000000 END AS end_us
 FROM events
),
agg AS (
 SELECT dag_id, run_id, task_id, count(*) FILTER (WHERE state = 'scheduled') AS scheduled,
  count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'queued') AS queued,
  count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'success') AS success,
  count(*) FILTER (WHERE state = 'skipped') AS skipped, min(start_us) AS started, max(end_us) AS ended
 FROM tasks GROUP BY ALL
),
summary AS (
 SELECT dag_id, run_id, task_id,
  CASE WHEN running > 0 THEN 'running' WHEN queued > 0 THEN 'queued' WHEN scheduled > 0 THEN 'scheduled'
   WHEN failed > 0 AND success = 0 AND skipped = 0 THEN 'failed' WHEN success > 0 AND failed = 0 THEN 'success'
   WHEN skipped > 0 AND failed = 0 AND success = 0 THEN 'skipped'
   WHEN failed + success + skipped = 0 THEN 'pending' ELSE 'mixed' END AS status,
  started AS task_start_time, ended AS task_end_time,
  CAST(round((coalesce(ended, epoch_us(TIMESTAMP '2024-02-01 00:00:00')) - started) / 1000000.0) AS BIGINT)
   AS duration_s,
  scheduled, running, queued, failed, success, skipped FROM agg
)"""


def _micros(df):
    return df.withColumns({name: F.unix_micros(name) for name in ("task_start_time", "task_end_time")})


@query("task_state_summary", f"WITH {_TASKS_SQL} SELECT * FROM summary")
def task_state_summary(spark, sf):
    return _micros(R.task_state_summary(V.task_instances(spark, sf), F.lit(NOW).cast("timestamp")))


@query(
    "task_state_latest_runs",
    f"""WITH {_TASKS_SQL} SELECT * FROM summary WHERE run_id IN (
 SELECT DISTINCT run_id FROM tasks ORDER BY run_id DESC LIMIT 5)""",
)
def task_state_latest_runs(spark, sf):
    tasks = V.task_instances(spark, sf)
    runs = V.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg(
        F.min(F.col("ts").cast("timestamp")).alias("queued_at"))
    return _micros(R.task_state_summary(tasks, F.lit(NOW).cast("timestamp"), R.latest_runs(runs, 5)))


_ATTEMPTS_SQL = """
attempts AS (
 SELECT event_id AS seq, 'cfg-' || CAST(user_id % 5 AS VARCHAR) AS config_id,
  'company-' || CAST(user_id % 3 AS VARCHAR) AS company,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN 'jobs' ELSE 'details' END AS endpoint,
  event_type <> 'error' AS success, value AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 AS VARCHAR)
   ELSE '' END AS error_cause
 FROM events
),
causes AS (
 SELECT config_id, company, endpoint, error_cause, count(*) AS n, min(seq) AS first_seq FROM attempts
 WHERE NOT success GROUP BY ALL
),
top_causes AS (
 SELECT config_id, company, endpoint, string_agg(error_cause || ' (x' || n || ')', ' | ' ORDER BY rn)
  AS top_failure_causes
 FROM (SELECT *, row_number() OVER (PARTITION BY config_id, company, endpoint ORDER BY n DESC, first_seq) AS rn
  FROM causes) WHERE rn <= 3 GROUP BY ALL
),
summary AS (
 SELECT config_id, company, endpoint, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes,
  count(*) FILTER (WHERE NOT success) AS failures,
  round(100.0 * count(*) FILTER (WHERE success) / count(*), 2) AS success_rate_pct,
  round(avg(latency_ms), 2) AS mean_latency_ms_all,
  round(avg(latency_ms) FILTER (WHERE success), 2) AS mean_latency_ms_success,
  round(quantile_cont(latency_ms, 0.5) FILTER (WHERE success), 2) AS p50_latency_ms_success,
  round(quantile_cont(latency_ms, 0.95) FILTER (WHERE success), 2) AS p95_latency_ms_success
 FROM attempts GROUP BY config_id, company, endpoint
)"""


@query(
    "benchmark_summary",
    f"""WITH {_ATTEMPTS_SQL} SELECT s.*, coalesce(t.top_failure_causes, '') AS top_failure_causes FROM summary s
 LEFT JOIN top_causes t USING (config_id, company, endpoint)""",
)
def benchmark_summary(spark, sf):
    return R.benchmark_summary(V.attempts(spark, sf))


@query("top_failure_causes", f"WITH {_ATTEMPTS_SQL} SELECT * FROM top_causes")
def top_failure_causes(spark, sf):
    return R.top_failure_causes(V.attempts(spark, sf), ["config_id", "company", "endpoint"])


@query(
    "rank_configs",
    f"""WITH {_ATTEMPTS_SQL}
 SELECT config_id, round(avg(success_rate_pct), 6) AS avg_success_rate_pct,
  round(avg(p95_latency_ms_success), 6) AS avg_p95_latency_ms FROM summary GROUP BY config_id""",
)
def rank_configs(spark, sf):
    return R.rank_configs(R.benchmark_summary(V.attempts(spark, sf))).select(
        "config_id", F.round("avg_success_rate_pct", 6).alias("avg_success_rate_pct"),
        F.round("avg_p95_latency_ms", 6).alias("avg_p95_latency_ms"),
    )


@query(
    "exact_percentiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95
 FROM lineitem GROUP BY l_returnflag""",
)
def exact_percentiles(spark, sf):
    from ..operators.ranking import exact_percentiles as percentiles

    return percentiles(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@query(
    "peek_details",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, CASE WHEN length(job_description_path) > 24 THEN substr(job_description_path, 1, 24) || ' ...'
  ELSE coalesce(job_description_path, '') END AS job_description_path
 FROM run_details WHERE run_id = 'r1' ORDER BY external_job_id DESC LIMIT 50""",
)
def peek_details(spark, sf):
    return R.peek(V.details(spark, sf, "r1"), 50, "external_job_id", "job_description_path", 24).select(
        "external_job_id", "job_description_path"
    )
