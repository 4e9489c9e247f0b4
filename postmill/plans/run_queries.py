"""Queries on the write path: merges, carry-forward, quality gates, run state, work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import ranking as R
from ..session import scratch_path, stored_once
from ..sources import keyed
from . import views as V
from .register import Registry

query = Registry()


def _ts(text):
    return F.lit(text).cast("timestamp")


# --- Merges -----------------------------------------------------------------------------------


@query(
    "upsert_companies",
    f"""WITH {V.BASE_SQL}
 SELECT company, CASE WHEN company IN (SELECT source FROM documents) THEN upper(company) ELSE
  upper(substr(company, 1, 1)) || substr(company, 2) END AS display_name
 FROM (SELECT company FROM postings UNION SELECT 'meta' UNION SELECT source FROM documents)""",
)
def upsert_companies(spark, sf):
    rows = V.table(spark, sf, "documents").select(
        F.lit("r2").alias("run_id"), F.col("source").alias("company"), F.upper("source").alias("display_name")
    ).distinct()
    return M.upsert_companies(V.companies(spark, sf), rows).select("company", "display_name")


_UPSERT_SQL = f"""WITH {V.BASE_SQL}
 SELECT external_job_id, company, title || ' (again)' AS title,
  CASE WHEN lang <> 'en' THEN 'fresh' WHEN o_orderstatus <> 'O' THEN 'lang-' || lang || ',' || source ELSE '' END
   AS skills, false AS is_missing_details
 FROM postings"""


def _upserts(spark, sf):
    """(stored postings, a first listing of all, a second one)."""
    jobs = V.jobs(spark, sf, places=False)
    closed = V.table(spark, sf, "orders").where(F.col("o_orderstatus") != "O").select(
        F.col("o_orderkey").cast("string").alias("external_job_id"))
    return jobs.join(closed, "external_job_id", "left_semi"), _with_fresh_skills(jobs), _with_fresh_skills(
        jobs.withColumn("title", F.concat("title", F.lit(" (again)"))))


def _with_fresh_skills(jobs):
    english = F.array_contains("skills", "lang-en")
    return jobs.withColumn("skills", F.when(english, F.array(F.lit(" "))).otherwise(F.array(F.lit(" fresh "))))


def _shown(jobs):
    return jobs.select(
        "external_job_id", "company", "title", F.array_join("skills", ",").alias("skills"), "is_missing_details"
    )


@query("upsert_jobs", _UPSERT_SQL)
def upsert_jobs(spark, sf):
    stored, first, again = _upserts(spark, sf)
    rows = first.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))
    return _shown(M.upsert_jobs(stored, rows, seq="seq"))


@query("upsert_jobs_on_read", _UPSERT_SQL)
def upsert_jobs_on_read(spark, sf):
    """The same as two change files next to a bucketed base; the first is folded, the second merged when read."""
    stored, first, again = _upserts(spark, sf)
    table = keyed.job_table(spark, scratch_path(spark, "keyed"), stored.schema, M.KEY, buckets=8).create(stored)
    keyed.upsert_jobs(table, first, 1)
    table.fold()
    keyed.upsert_jobs(table, again, 2)
    return _shown(table.read())


@query(
    "last_write_wins",
    """SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id
 FROM events GROUP BY user_id, event_type""",
)
def last_write_wins(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return R.last_write_wins(e, ["user_id", "event_type"], "event_id")


@query(
    "upsert_details",
    f"""WITH {V.BASE_SQL}
 SELECT company, external_job_id, CASE WHEN o_orderstatus = 'F' AND is_missing_details THEN
   CASE WHEN quality = 0 THEN '  ' WHEN p_size = 50 THEN NULL
    ELSE 'job-details/r2/' || company || '/' || external_job_id || '.txt' END
  ELSE 'new/' || external_job_id END AS job_description_path
 FROM postings WHERE o_orderstatus = 'F' OR NOT is_missing_details""",
)
def upsert_details(spark, sf):
    rows = V.jobs(spark, sf, places=False).where(~F.col("is_missing_details")).select(
        "run_id", "company", "external_job_id",
        F.concat(F.lit("new/"), F.col("external_job_id")).alias("job_description_path"),
    )
    return M.upsert_details(V.details(spark, sf, fetched_only=True), rows).select(
        "company", "external_job_id", "job_description_path"
    )


@query(
    "fill_posted_ts",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, CAST(epoch(coalesce(posted_ts, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END)) AS BIGINT)
  AS posted_ts FROM postings""",
)
def fill_posted_ts(spark, sf):
    jobs = V.jobs(spark, sf, places=False)
    dates = V.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").cast("string").alias("external_job_id"),
        F.col("o_orderdate").cast("timestamp").alias("found_ts"),
    )
    dated = jobs.select(*M.KEY).join(dates, "external_job_id").withColumnRenamed("found_ts", "posted_ts")
    return M.fill_posted_ts(jobs, dated).select("external_job_id", epoch_seconds(F.col("posted_ts")).alias("posted_ts"))


@query(
    "mark_missing",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, is_missing_details OR coalesce(quality, 1) = 0 AS is_missing_details FROM postings""",
)
def mark_missing(spark, sf):
    jobs = V.jobs(spark, sf, places=False)
    bad = V.table(spark, sf, "labels").where(F.col("quality") == 0).select(
        F.col("doc_id").cast("string").alias("external_job_id"))
    return M.mark_missing(jobs, jobs.select(*M.KEY).join(bad, "external_job_id")).select(
        "external_job_id", "is_missing_details"
    )


@query(
    "apply_features",
    f"""WITH {V.BASE_SQL}
 SELECT p.external_job_id,
  CASE WHEN p.lang = 'de' THEN '' WHEN p.lang = 'en' THEN p.source ELSE 'lang-' || p.lang || ',' || p.source END
   AS skills,
  CASE WHEN p.lang = 'de' THEN 0 WHEN p.lang = 'en' THEN coalesce(len(e.embedding), 0) ELSE 0 END AS dims
 FROM postings p LEFT JOIN embeddings e ON e.vec_id = p.doc_id""",
)
def apply_features(spark, sf):
    jobs = V.jobs(spark, sf, embedding=True, places=False)
    docs = V.table(spark, sf, "documents").where(F.col("lang").isin("en", "de"))
    features = docs.select(
        F.col("doc_id").cast("string").alias("external_job_id"),
        F.when(F.col("lang") == "de", F.lit("  ")).otherwise(F.col("text")).alias("description"),
        F.array(F.concat(F.lit(" "), F.col("source")), F.lit("")).alias("_new"),
    )
    keyed = jobs.select(*M.KEY, "job_description_embedding").join(features, "external_job_id").select(
        *M.KEY, "description", F.col("_new").alias("skills"), F.col("job_description_embedding").alias("embedding")
    )
    stored = jobs.withColumn("job_description_embedding", F.array().cast("array<float>"))
    return M.apply_features(stored, keyed).select(
        "external_job_id", F.array_join("skills", ",").alias("skills"),
        F.size("job_description_embedding").cast("bigint").alias("dims"),
    )


# --- Carry-forward and work lists --------------------------------------------------------------


@query(
    "carry_forward_details",
    f"""WITH {V.BASE_SQL}
 SELECT 'r2' AS run_id, s.company, s.external_job_id, s.job_description_path FROM run_details s
 WHERE s.run_id = 'r1'
  AND EXISTS (SELECT 1 FROM postings p WHERE p.company = s.company AND p.external_job_id = s.external_job_id)
  AND NOT EXISTS (SELECT 1 FROM run_details t WHERE t.run_id = 'r2' AND t.o_orderstatus = 'F'
   AND t.company = s.company AND t.external_job_id = s.external_job_id)""",
)
def carry_forward_details(spark, sf):
    return M.carry_forward_details(
        V.details(spark, sf, "r1"), V.jobs(spark, sf, places=False), V.details(spark, sf, fetched_only=True), "r2", _ts(V.VERSION_2)
    ).select("run_id", "company", "external_job_id", "job_description_path")


@query(
    "backfill_posted_ts",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, CAST(epoch(CASE WHEN lang = 'en' AND o_orderstatus = 'O' THEN NULL ELSE posted_ts END)
  AS BIGINT) AS posted_ts FROM postings""",
)
def backfill_posted_ts(spark, sf):
    target = V.jobs(spark, sf, places=False).withColumn(
        "posted_ts", F.when(~F.array_contains("skills", "lang-en"), F.col("posted_ts"))
    )
    return M.backfill_posted_ts(target, V.jobs(spark, sf, "r1", places=False), V.details(spark, sf, "r1")).select(
        "external_job_id", epoch_seconds(F.col("posted_ts")).alias("posted_ts")
    )


def _scraped(spark, sf):
    """Listed ids; English postings are listed on two pages."""
    ids = V.jobs(spark, sf, places=False).select("company", "external_job_id", "skills")
    return ids.drop("skills").unionByName(ids.where(F.array_contains("skills", "lang-en")).drop("skills"))


def _current_details(spark, sf):
    fetched = V.details(spark, sf, fetched_only=True)
    carried = M.carry_forward_details(V.details(spark, sf, "r1"), V.jobs(spark, sf, places=False), fetched, "r2", _ts(V.VERSION_2))
    return fetched.unionByName(carried)


@query(
    "pending_detail_requests",
    f"""WITH {V.BASE_SQL} SELECT company, external_job_id FROM postings WHERE o_orderstatus = 'O'""",
)
def pending_detail_requests(spark, sf):
    return M.pending_detail_requests(_scraped(spark, sf), _current_details(spark, sf))


@query(
    "interleave_requests",
    f"""WITH {V.BASE_SQL}
 SELECT company, external_job_id, row_number() OVER (PARTITION BY company ORDER BY external_job_id) AS turn,
  CASE company WHEN 'netflix' THEN 1 WHEN 'amazon' THEN 2 WHEN 'google' THEN 3 WHEN 'apple' THEN 4 END AS position
 FROM postings WHERE company IN ('netflix', 'amazon', 'google', 'apple')""",
)
def interleave_requests(spark, sf):
    order = ["netflix", "amazon", "google", "apple", "meta"]
    positions = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(name) for name in order])).alias("position", "company")
    ).withColumn("position", F.col("position") + 1)
    requests = V.jobs(spark, sf, places=False).select("company", "external_job_id")
    return R.interleave(requests, "company", positions, ["external_job_id"]).select(
        "company", "external_job_id", "turn", "position"
    )


@query(
    "skill_requests",
    f"""WITH {V.BASE_SQL}
 SELECT p.company, p.external_job_id, d.job_description_path FROM postings p
 JOIN run_details d ON d.run_id = 'r2' AND d.company = p.company AND d.external_job_id = p.external_job_id
 WHERE NOT p.is_missing_details AND trim(coalesce(d.job_description_path, '')) <> '' AND p.lang <> 'en'
  AND p.company IN ('amazon', 'apple')""",
)
def skill_requests(spark, sf):
    from ..operators.browse import jobs_with_details
    from ..operators.filters import has_description

    wanted = spark.range(1).select(F.explode(F.array(F.lit("amazon"), F.lit("apple"))).alias("company"))
    jobs = V.jobs(spark, sf, places=False).withColumn(
        "skills", F.when(F.array_contains("skills", "lang-en"), F.col("skills")).otherwise(F.array().cast("array<string>"))
    )
    eligible = jobs_with_details(jobs, V.details(spark, sf)).where(
        (F.coalesce(F.size("skills"), F.lit(0)) == 0) & has_description()
    )
    return eligible.join(wanted, "company", "left_semi").select(
        "company", "external_job_id", "job_description_path"
    ).orderBy("company", "external_job_id")



# --- Counts and gates --------------------------------------------------------------------------


@query(
    "jobs_counts",
    f"""WITH {V.BASE_SQL}
 SELECT c.company, count(p.doc_id) FILTER (WHERE NOT p.is_missing_details) AS jobs,
  count(p.doc_id) FILTER (WHERE p.is_missing_details) AS missing_details
 FROM (SELECT company FROM postings UNION SELECT 'meta') c LEFT JOIN postings p USING (company) GROUP BY c.company""",
)
def jobs_counts(spark, sf):
    return Q.zero_filled(V.companies(spark, sf), Q.jobs_counts(V.jobs(spark, sf, places=False)))


@query(
    "details_counts",
    f"""WITH {V.BASE_SQL}
 SELECT p.company, count(*) AS details,
  count(*) FILTER (WHERE trim(coalesce(d.job_description_path, '')) = '') AS missing_description,
  count(*) FILTER (WHERE trim(coalesce(d.job_description_path, '')) <> '' AND coalesce(len(e.embedding), 0) = 0)
   AS missing_embedding
 FROM postings p JOIN run_details d ON d.run_id = 'r2' AND d.company = p.company
  AND d.external_job_id = p.external_job_id
 LEFT JOIN embeddings e ON e.vec_id = p.doc_id
 WHERE NOT p.is_missing_details GROUP BY p.company""",
)
def details_counts(spark, sf):
    return Q.details_counts(V.jobs(spark, sf, embedding=True, places=False), V.details(spark, sf))


@query(
    "expected_counts",
    f"""WITH {V.BASE_SQL}
 SELECT company, count(*) AS expected_jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS expected_details
 FROM postings GROUP BY company""",
)
def expected_counts(spark, sf):
    scraped = _scraped(spark, sf)
    return Q.expected_counts(scraped, M.pending_detail_requests(scraped, _current_details(spark, sf)))


_COUNTS_SQL = f"""WITH {V.BASE_SQL},
detail_counts AS (
 SELECT p.company, count(*) AS details,
  count(*) FILTER (WHERE trim(coalesce(d.job_description_path, '')) = '') AS missing_description,
  count(*) FILTER (WHERE trim(coalesce(d.job_description_path, '')) <> '' AND coalesce(len(e.embedding), 0) = 0)
   AS missing_embedding
 FROM postings p JOIN run_details d ON d.run_id = 'r2' AND d.company = p.company
  AND d.external_job_id = p.external_job_id AND d.o_orderstatus <> 'O'
 LEFT JOIN embeddings e ON e.vec_id = p.doc_id
 WHERE NOT p.is_missing_details GROUP BY p.company
),
job_counts AS (
 SELECT company, count(*) AS expected_jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS expected_details,
  count(*) FILTER (WHERE NOT is_missing_details) AS jobs, count(*) FILTER (WHERE is_missing_details) AS missing_details
 FROM postings GROUP BY company
),
counts AS (
 SELECT c.company, coalesce(expected_jobs, 0) AS expected_jobs, coalesce(expected_details, 0) AS expected_details,
  coalesce(jobs, 0) AS jobs, coalesce(missing_details, 0) AS missing_details, coalesce(details, 0) AS details,
  coalesce(missing_description, 0) AS missing_description, coalesce(missing_embedding, 0) AS missing_embedding
 FROM (SELECT company FROM postings UNION SELECT 'meta') c LEFT JOIN job_counts USING (company)
 LEFT JOIN detail_counts USING (company)
)"""


def _run_tables(spark, sf):
    """Tables of the run that the gates read: written by the first gate of a session, one scan of each afterwards."""
    names = ("scraped", "details", "jobs", "companies")

    def write(path):
        jobs = V.jobs(spark, sf, embedding=True, places=False).select(
            "run_id", "company", "external_job_id", "is_missing_details", "job_description_embedding")
        tables = (_scraped(spark, sf), _current_details(spark, sf), jobs, V.companies(spark, sf))
        for name, table in zip(names, tables):
            table.write.parquet(f"{path}/{name}")

    path = stored_once(spark, "run", sf, write)
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def _counts(spark, sf):
    t = _run_tables(spark, sf)
    requests = M.pending_detail_requests(t["scraped"], t["details"])
    return Q.consistency_counts(t["companies"], t["scraped"], requests, t["jobs"], t["details"])


def _violations_sql(want):
    return f"""
 SELECT company, 1 AS rule, 'company=' || company || ' rule=jobs_expected_mismatch expected='
  || greatest(expected_jobs - missing_details, 0) || ' actual=' || jobs || ' missing_details=' || missing_details
  AS message FROM counts WHERE jobs <> greatest(expected_jobs - missing_details, 0)
 UNION ALL
 SELECT company, 2, 'company=' || company || ' rule=details_count_mismatch expected=' || {want} || ' actual='
  || details || ' expected_detail_jobs=' || expected_details || ' missing_details=' || missing_details
 FROM counts WHERE details <> {want}
 UNION ALL
 SELECT company, 3, 'company=' || company || ' rule=missing_job_description count=' || missing_description
 FROM counts WHERE missing_description > 0
 UNION ALL
 SELECT company, 4, 'company=' || company || ' rule=missing_job_description_embedding count=' || missing_embedding
 FROM counts WHERE missing_embedding > 0"""


@query("consistency_counts", f"{_COUNTS_SQL} SELECT * FROM counts")
def consistency_counts(spark, sf):
    return _counts(spark, sf)


@query("gate_violations", _COUNTS_SQL + _violations_sql("jobs"))
def gate_violations(spark, sf):
    return Q.violations(_counts(spark, sf))


@query(
    "gate_violations_requests_only",
    _COUNTS_SQL + _violations_sql("greatest(expected_details - missing_details, 0)"),
)
def gate_violations_requests_only(spark, sf):
    return Q.violations(_counts(spark, sf), mode="requests_only")


@query(
    "gate_failure_message",
    f"""SELECT string_agg(message, ' | ' ORDER BY company, rule) AS message FROM (
 SELECT * FROM ({_COUNTS_SQL} {_violations_sql("jobs")}) ORDER BY company, rule LIMIT 10)""",
)
def gate_failure_message(spark, sf):
    return Q.failure_message(Q.violations(_counts(spark, sf)), ["company", "rule"])


@query(
    "error_rollup",
    """WITH errors AS (
  SELECT 0 AS part, event_id AS seq, 'first ' || props AS message FROM events WHERE event_type = 'error' AND value > 300
  UNION ALL SELECT 1, event_id, 'page ' || props FROM events WHERE event_type = 'error'
  UNION ALL SELECT 2, event_id, 'detail ' || props FROM events WHERE event_type = 'error')
 SELECT CASE WHEN count(*) > 0 THEN 'failed' ELSE 'in_progress' END AS status, count(*) = 0 AS db_ready,
  count(*) AS error_count, (SELECT string_agg(message, ' | ' ORDER BY part, seq) FROM
   (SELECT * FROM errors ORDER BY part, seq LIMIT 5)) AS db_error_message
 FROM errors""",
)
def error_rollup(spark, sf):
    e = V.table(spark, sf, "events")

    def part(name, failed):
        return e.select(F.col("event_id").alias("seq"), (~failed).alias("success"),
                        F.concat(F.lit(f"{name} "), F.col("props")).alias("error"))

    error = F.col("event_type") == "error"
    return Q.error_rollup(part("first", error & (F.col("value") > 300)), part("page", error), part("detail", error))


# --- Publish state -----------------------------------------------------------------------------


def run_events(spark, sf):
    """Run events from the event log: one run per user."""
    e = V.table(spark, sf, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("ts").cast("timestamp").alias("version_ts"),
        F.when(kind == "signup", F.when(k < 30, "start").otherwise("es_published"))
        .when(kind == "purchase", "db_published")
        .when(kind == "click", "es")
        .when((kind == "view") & (k < 20), "succeeded")
        .otherwise("db")
        .alias("kind"),
        F.when(kind == "error", F.lit("failed")).when((kind == "view") & (k >= 20), F.lit("in_progress")).alias("status"),
        F.when(kind.isin("error", "view"), kind != "error").alias("db_ready"),
        F.when(kind == "error", F.col("props")).alias("db_error_message"),
        F.when(kind == "click", k < 50).alias("es_ready"),
        F.when((kind == "click") & (k >= 50), F.col("props")).alias("es_error_message"),
        "props",
    )


_EVENTS_SQL = """
log AS (
 SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts AS happened, event_type AS et, props,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
),
events_of_runs AS (
 SELECT *, CASE WHEN et = 'signup' AND k < 30 THEN 'start' WHEN et = 'signup' THEN 'es_published'
  WHEN et = 'purchase' THEN 'db_published' WHEN et = 'click' THEN 'es' WHEN et = 'view' AND k < 20 THEN 'succeeded'
  ELSE 'db' END AS kind FROM log
),
starts AS (SELECT run_id, max(seq) AS start_seq, min(happened) AS created_at FROM events_of_runs WHERE kind = 'start'
 GROUP BY run_id),
live AS (SELECT e.*, s.created_at FROM events_of_runs e JOIN starts s USING (run_id) WHERE e.seq >= s.start_seq),
states AS (
 SELECT run_id,
  arg_max(CASE kind WHEN 'start' THEN 'in_progress' WHEN 'succeeded' THEN 'succeeded'
   ELSE CASE WHEN et = 'error' THEN 'failed' ELSE 'in_progress' END END, seq)
   FILTER (WHERE kind IN ('start', 'succeeded', 'db')) AS status,
  coalesce(arg_max(et <> 'error', seq) FILTER (WHERE kind = 'db'), false) AS db_ready,
  max(happened) FILTER (WHERE kind = 'db_published') AS db_published_at,
  nullif(arg_max(CASE WHEN et = 'error' THEN props ELSE '' END, seq) FILTER (WHERE kind = 'db'), '')
   AS db_error_message,
  coalesce(arg_max(k < 50, seq) FILTER (WHERE kind = 'es'), false) AS es_ready,
  max(happened) FILTER (WHERE kind = 'es_published') AS es_published_at,
  nullif(arg_max(CASE WHEN k >= 50 THEN props ELSE '' END, seq) FILTER (WHERE kind = 'es'), '') AS es_error_message,
  min(created_at) AS created_at, max(happened) AS updated_at
 FROM live GROUP BY run_id
)"""
_STATE_COLUMNS_SQL = """run_id, status, db_ready, es_ready, db_error_message, es_error_message,
 epoch_us(db_published_at) AS db_published_at, epoch_us(es_published_at) AS es_published_at,
 epoch_us(created_at) AS created_at, epoch_us(updated_at) AS updated_at"""


def _state_columns(states):
    dates = ["db_published_at", "es_published_at", "created_at", "updated_at"]
    return states.select(
        "run_id", "status", "db_ready", "es_ready", "db_error_message", "es_error_message",
        *[F.unix_micros(name).alias(name) for name in dates],
    )


@query("run_state", f"WITH {_EVENTS_SQL} SELECT {_STATE_COLUMNS_SQL} FROM states")
def run_state(spark, sf):
    return _state_columns(Q.run_state(run_events(spark, sf)))


@query(
    "failed_runs",
    f"""WITH {_EVENTS_SQL} SELECT {_STATE_COLUMNS_SQL} FROM states WHERE status = 'failed'
 ORDER BY updated_at DESC LIMIT 20""",
)
def failed_runs(spark, sf):
    from ..operators.reports import failed_runs as report

    return _state_columns(report(Q.run_state(run_events(spark, sf)), 20))


@query(
    "active_run",
    f"""WITH {_EVENTS_SQL}, pointer AS (
  SELECT 'ns-' || k AS namespace, arg_max(run_id, happened) AS run_id FROM events_of_runs
  WHERE kind = 'db_published' GROUP BY k)
 SELECT p.namespace, p.run_id, s.status FROM pointer p JOIN states s USING (run_id) WHERE s.db_ready""",
)
def active_run(spark, sf):
    events = run_events(spark, sf)
    pointers = events.where(F.col("kind") == "db_published").select(
        F.concat(F.lit("ns-"), F.get_json_object("props", "$.k")).alias("namespace"), "run_id",
        F.col("at").alias("updated_at"),
    )
    return Q.active_run(pointers, Q.run_state(events), None).select("namespace", "run_id", "status")


# A run's counts come from its events: an error is a text that is missing, a sign-up a detail that is not there.
@query(
    "publish_readiness",
    f"""WITH {_EVENTS_SQL}, broken AS (
  SELECT run_id FROM log GROUP BY run_id
  HAVING count(*) FILTER (WHERE et = 'error' AND k >= 90) > 0 OR count(*) FILTER (WHERE et = 'signup' AND k >= 95) > 0)
 SELECT run_id, db_ready AND es_ready AND run_id NOT IN (SELECT run_id FROM broken) AS publishable FROM states""",
)
def publish_readiness(spark, sf):
    events = run_events(spark, sf)
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    counts = V.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(
        F.lit("amazon").alias("company"), F.count("*").alias("expected_jobs"), F.count("*").alias("expected_details"),
        F.count("*").alias("jobs"), F.lit(0).alias("missing_details"),
        F.count_if(~((kind == "signup") & (k >= 95))).alias("details"),
        F.count_if((kind == "error") & (k >= 90)).alias("missing_description"), F.lit(0).alias("missing_embedding"),
    )
    return Q.readiness(Q.run_state(events), Q.violations(counts)).select("run_id", "publishable")
