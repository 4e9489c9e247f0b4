"""Streaming queries over the event log, catalog storage, and the checks that compare them with batch results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import skills as K
from ..operators.reports import benchmark_summary, capacity_check
from ..session import scratch_path
from ..sources import catalog as C
from ..sources import payloads
from ..streaming import heartbeat, ingest, lease
from . import search_queries, text_queries, views as V
from .register import Registry

query = Registry()

DAY = 86400
AS_OF_EPOCH = 1706659200  # 2024-01-31


# Parts that the event log comes in, and seconds that an event may come late.
PARTS, LATENESS = 4, 3000


def _run_in_parts(spark, sf, start):
    """The event log as a stream that comes in parts, out of order by less than ``LATENESS`` seconds.

    Each part is written as many files, then ``start(stream)`` runs until all files are read: it goes on from its checkpoint, as
    after a restart. Part 1 is delivered twice.
    """
    path = scratch_path(spark, "event-files")
    events = V.table(spark, sf, "events")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LATENESS)) * 1_000_000
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    part = F.least(F.floor((arrival - (first or 0)) * PARTS / F.lit(max(1, (last or 0) - (first or 0)))), F.lit(PARTS - 1))
    for number in (0, 1, 1, *range(2, PARTS)):
        events.where(part == number).write.mode("append").parquet(path)
        start(ingest.read_stream(spark, path, events.schema)).awaitTermination()


# --- Streams ----------------------------------------------------------------------------------


@query(
    "stream_ingest_postings",
    """SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id
 FROM events GROUP BY user_id, event_type""",
)
def stream_ingest_postings(spark, sf):
    path, checkpoint = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-checkpoint")
    keys, columns = ["user_id", "event_type"], ["user_id", "event_type", "value", "event_id"]

    def start(stream):
        timed = stream.withColumn("event_time", F.col("ts").cast("timestamp"))
        once = ingest.without_replays(timed, ["event_id"], "event_time", f"{LATENESS} seconds")
        return ingest.ingest(once.select(*columns), keys, "event_id", path, checkpoint)

    _run_in_parts(spark, sf, start)
    schema = V.table(spark, sf, "events").select(*columns).schema
    # The first batches are folded, the later ones are read next to the fold.
    ingest.compact(spark, path, schema, keys, "event_id", PARTS // 2)
    return ingest.current(spark, path, schema, keys, "event_id")


def lease_reasons(events):
    """Enqueue outcomes from the event log."""
    kind = F.col("event_type")
    # A stream's own time column keeps its watermark.
    time = F.col("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp").alias("ts")
    return events.select(
        time,
        F.concat(F.lit("scope-"), (F.col("user_id") % 6).cast("string")).alias("scope"),
        F.when(kind == "signup", "enqueued").when(kind == "error", "blocked").when(kind == "click", "inuse")
        .when(kind == "view", "duplicate").otherwise("capacity").alias("reason"),
    )


_HEARTBEAT = """SELECT epoch(w)::BIGINT AS window_start, {scope} count(*) FILTER (WHERE event_type = 'signup') AS accepted,
  count(*) FILTER (WHERE event_type <> 'signup') AS rejected,
  count(*) FILTER (WHERE event_type = 'purchase') AS rejected_capacity,
  count(*) FILTER (WHERE event_type = 'error') AS rejected_blocked,
  count(*) FILTER (WHERE event_type = 'click') AS rejected_inuse,
  count(*) FILTER (WHERE event_type = 'view') AS rejected_duplicate,
  CAST(0 AS BIGINT) AS rejected_invalid_capacity, CAST(0 AS BIGINT) AS rejected_unknown
 FROM (SELECT *, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS w,
  'scope-' || CAST(user_id % 6 AS VARCHAR) AS scope FROM events)
 {where} GROUP BY ALL"""


@query("heartbeat_counts", _HEARTBEAT.format(scope="scope,", interval="15 seconds", where=""))
def heartbeat_counts(spark, sf):
    found = heartbeat.counts(lease_reasons(V.table(spark, sf, "events")))
    return found.withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "stream_heartbeat_counts",
    _HEARTBEAT.format(
        scope="scope,", interval="1 hour",
        where="WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR"),
)
def stream_heartbeat_counts(spark, sf):
    path, checkpoint = scratch_path(spark, "heartbeat"), scratch_path(spark, "heartbeat-checkpoint")

    def start(stream):
        once = ingest.without_replays(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "1 hour")
        return heartbeat.write_counts(lease_reasons(once), path, checkpoint, "1 hour")

    _run_in_parts(spark, sf, start)
    return spark.read.parquet(path).withColumn("window_start", F.unix_seconds("window_start"))


def lease_events(events):
    """Lease actions from the event log; three tokens per resource."""
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("scope-"), (F.col("user_id") % 6).cast("string")).alias("scope"),
        F.col("user_id").cast("string").alias("resource"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "lease").when(kind == "view", "return").when(kind == "error", "block")
        .otherwise("enqueue").alias("action"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")).alias("token"),
    )


_LEASE_SQL = f"""
log AS (
 SELECT 'scope-' || CAST(user_id % 6 AS VARCHAR) AS scope, CAST(user_id AS VARCHAR) AS resource,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, event_type AS et,
  CAST(json_extract_string(props, '$.k') AS INT) % 3 AS token FROM events
),
lease AS (SELECT scope, resource, t, seq, token FROM log WHERE et = 'click'
 QUALIFY row_number() OVER (PARTITION BY scope, resource ORDER BY t DESC, seq DESC) = 1),
ended AS (
 SELECT g.scope, g.resource, g.t AS end_t, g.et AS end_et FROM log g JOIN lease l USING (scope, resource)
 WHERE g.et IN ('view', 'error') AND (g.t > l.t OR (g.t = l.t AND g.seq > l.seq)) AND g.token = l.token
  AND g.t < l.t + {2 * DAY}
 QUALIFY row_number() OVER (PARTITION BY g.scope, g.resource ORDER BY g.t, g.seq) = 1
),
base AS (
 SELECT a.scope, a.resource, l.t AS lease_t, e.end_et, a.enq,
  CASE WHEN e.end_et = 'error' THEN e.end_t + {4 * DAY} ELSE l.t + {2 * DAY} END AS free_at
 FROM (SELECT scope, resource, max(t) FILTER (WHERE et IN ('signup', 'purchase')) AS enq FROM log GROUP BY ALL) a
 LEFT JOIN lease l USING (scope, resource) LEFT JOIN ended e USING (scope, resource)
),
states AS (
 SELECT scope, resource, CASE
  WHEN lease_t IS NULL THEN CASE WHEN enq IS NOT NULL THEN 'available' ELSE 'missing' END
  WHEN end_et = 'view' THEN 'available' WHEN enq >= free_at THEN 'available'
  WHEN {AS_OF_EPOCH} < free_at THEN CASE WHEN end_et = 'error' THEN 'blocked' ELSE 'inuse' END
  ELSE 'missing' END AS state FROM base
)"""


@query("lease_state", f"WITH {_LEASE_SQL} SELECT * FROM states")
def lease_state(spark, sf):
    return lease.lease_states(lease_events(V.table(spark, sf, "events")), F.lit(AS_OF_EPOCH), 2 * DAY, 4 * DAY)


@query("stream_lease_state", f"WITH {_LEASE_SQL} SELECT * FROM states")
def stream_lease_state(spark, sf):
    path, checkpoint = scratch_path(spark, "lease"), scratch_path(spark, "lease-checkpoint")
    _run_in_parts(spark, sf, lambda stream: lease.track(lease_events(stream), path, checkpoint, 2 * DAY, LATENESS, 4 * DAY))
    return lease.tracked_states(spark, path, F.lit(AS_OF_EPOCH), 2 * DAY, 4 * DAY)


@query(
    "capacity_check",
    f"""WITH {_LEASE_SQL}, scopes AS (
 SELECT scope, count(*) FILTER (WHERE state = 'available') AS available, count(*) FILTER (WHERE state = 'inuse') AS inuse,
  count(*) FILTER (WHERE state = 'blocked') AS blocked FROM states GROUP BY scope)
 SELECT sum(available)::BIGINT AS total_available, sum(inuse)::BIGINT AS total_inuse,
  sum(blocked)::BIGINT AS total_blocked,
  coalesce(string_agg(scope, ',' ORDER BY scope) FILTER (WHERE available < 20), '') AS shortages,
  count(*) > 0 AND count(*) FILTER (WHERE available < 20) = 0 AS ready FROM scopes""",
)
def capacity(spark, sf):
    return capacity_check(lease_state(spark, sf), 20)


# --- Storage ----------------------------------------------------------------------------------


def _catalog(spark):
    return C.Catalog(spark, scratch_path(spark, "catalog"))


@query(
    "scan_run",
    f"""WITH {V.BASE_SQL}
 SELECT 'r2' AS run_id, external_job_id, company, title, CAST(epoch(posted_ts) AS BIGINT) AS posted_ts FROM postings""",
)
def scan_run(spark, sf):
    catalog = _catalog(spark)
    catalog.write_run("jobs", "r1", V.jobs(spark, sf, "r1", places=False))
    catalog.write_run("jobs", "r2", V.jobs(spark, sf, places=False))
    return catalog.scan_run("jobs", "r2").select(
        "run_id", "external_job_id", "company", "title", F.unix_seconds("posted_ts").alias("posted_ts"))


@query(
    "read_descriptions",
    f"""WITH {V.BASE_SQL}
 SELECT p.external_job_id, CASE WHEN p.quality = 0 OR p.p_size = 50 THEN NULL ELSE p.text END AS description
 FROM postings p""",
)
def read_descriptions(spark, sf):
    catalog = _catalog(spark)
    texts = V.with_posting_columns(V.base(spark, sf, places=False)).select(
        "company", "external_job_id", F.col("text").alias("description"))
    C.write_descriptions(catalog, "r2", texts)
    return C.read_descriptions(catalog, V.details(spark, sf), ["r2"]).select("external_job_id", "description")


@query(
    "stage_companies",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, company,
  upper(substr(company, 1, 1)) || substr(company, 2) AS display_name
 FROM (SELECT DISTINCT user_id, event_type FROM events) e JOIN (VALUES ('view', 'amazon'), ('view', 'netflix'),
  ('click', 'google'), ('error', 'amazon'), ('error', 'apple'), ('error', 'google'), ('error', 'meta'),
  ('error', 'microsoft'), ('error', 'netflix')) v(event_type, company) USING (event_type)""",
)
def stage_companies(spark, sf):
    lists = {"view": " Netflix ,amazon,other,", "click": "GOOGLE", "error": " , ", "signup": "nobody"}
    kind = F.col("event_type")
    chosen = F.lit("nobody")
    for name, text in lists.items():
        chosen = F.when(kind == name, F.lit(text)).otherwise(chosen)
    requests = V.table(spark, sf, "events").select("user_id", "event_type").distinct().select(
        F.col("user_id").cast("string").alias("run_id"), chosen.alias("companies"))
    return C.stage_companies(requests, F.current_timestamp()).select("run_id", "company", "display_name")


@query(
    "write_index",
    f"""WITH {search_queries.DOCS_SQL}
 SELECT 'jobs-r-2' AS index_name, (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM post) AS postings,
  true AS es_ready""",
)
def write_index(spark, sf):
    catalog = _catalog(spark)
    catalog.start_run("R 2", datetime(2001, 8, 2, tzinfo=timezone.utc))
    stored = C.write_index(catalog, "R 2", search_queries.docs(spark, sf), docs_per_file=100)
    index = S.SearchIndex.read(spark, catalog.index_path("R 2"))
    postings = index.postings.agg(F.count("*").alias("postings")).withColumn("run_id", F.lit("R 2"))
    return postings.join(catalog.states().select("run_id", "es_ready"), "run_id").select(
        F.lit(C.index_name("R 2")).alias("index_name"), F.lit(stored).cast("bigint").alias("docs"), "postings", "es_ready")


@query(
    "publish_catalog",
    f"""WITH {V.BASE_SQL}
 SELECT 'r2' AS run_id, 'succeeded' AS status, company, count(*) AS jobs FROM postings GROUP BY company""",
)
def publish_catalog(spark, sf):
    catalog = _catalog(spark)
    for run, version in (("r1", datetime(2001, 8, 1, tzinfo=timezone.utc)), ("r2", datetime(2001, 8, 2, tzinfo=timezone.utc))):
        catalog.start_run(run, version)
        catalog.write_run("jobs", run, V.jobs(spark, sf, run, places=False))
        catalog.set_tables_status(run, "in_progress", True)
        catalog.set_index_status(run, True)
        catalog.publish(run)
    run = catalog.published_run()
    state = catalog.states().where(F.col("run_id") == run).select("run_id", "status")
    jobs = catalog.scan_run("jobs", run).groupBy("run_id", "company").agg(F.count("*").alias("jobs"))
    return jobs.join(state, "run_id").select("run_id", "status", "company", "jobs")


@query(
    "report_csv",
    "SELECT count(DISTINCT (user_id % 5, user_id % 3, CAST(json_extract_string(props, '$.k') AS INT) < 50)) AS report_rows,"
    " count(*) AS attempts FROM events",
)
def report_csv(spark, sf):
    path = scratch_path(spark, "report")
    C.write_report_csv(benchmark_summary(V.attempts(spark, sf)), path)
    stored = spark.read.csv(path, header=True, schema="config_id string, company string, endpoint string, attempts bigint,"
                            " successes bigint, failures bigint, success_rate_pct double, mean_latency_ms_all double,"
                            " mean_latency_ms_success double, p50_latency_ms_success double,"
                            " p95_latency_ms_success double, top_failure_causes string")
    return stored.agg(F.count("*").alias("report_rows"), F.sum("attempts").alias("attempts"))


@query(
    "raw_payloads",
    f"""WITH {V.BASE_SQL}
 SELECT source, external_job_id, title, job_type FROM (
  SELECT unnest(['meta', 'netflix']) AS source, external_job_id, title, job_type FROM postings)""",
)
def raw_payloads(spark, sf):
    """Pages of two sources stored as a bronze table, read back and parsed together."""
    posts = V.with_posting_columns(V.base(spark, sf, places=False)).withColumn("page", F.floor(F.col("doc_id") / 10))
    job = F.struct("title", F.col("external_job_id").alias("id"))
    pages = posts.groupBy("page").agg(F.collect_list(job).alias("jobs"))
    meta = F.to_json(F.struct(F.struct(F.struct(F.col("jobs").alias("all_jobs")).alias("job_search_with_featured_jobs"))
                              .alias("data")))
    named = F.transform("jobs", lambda j: F.struct(j["id"].alias("id"), j["title"].alias("posting_name")))
    netflix = F.to_json(F.struct(named.alias("positions")))
    rows = pages.select("page", F.explode(F.array(
        F.struct(F.lit("meta").alias("source"), meta.alias("payload")),
        F.struct(F.lit("netflix").alias("source"), netflix.alias("payload")))).alias("r"))
    path = scratch_path(spark, "bronze")
    rows.select("r.source", F.lit("list").alias("kind"), "page", F.lit(None).cast("string").alias("external_id"),
                "r.payload", F.current_timestamp().alias("fetched_at")).write.partitionBy("source").parquet(path)
    parsed = payloads.parse_all(payloads.read_raw_payloads(spark, path))
    return parsed.select(F.col("company").alias("source"), "external_job_id", "title", "job_type")


@query(
    "read_vocabulary",
    f"WITH {text_queries.VOCAB_SQL} SELECT key, skill FROM vocab",
)
def read_vocabulary(spark, sf):
    """All words of the benchmark texts in CSV files, all pairs of neighbouring words in keyword files; each in several files."""
    words, pairs = text_queries.words_and_pairs(spark, sf)
    technical, keywords = scratch_path(spark, "technical"), scratch_path(spark, "keywords")
    # Ranges of lines, so the files follow each other in the order of their names.
    words.repartitionByRange(4, "line").sortWithinPartitions("line").select(
        F.lit("").alias("Example"), F.col("skill").alias("Skill Name")
    ).write.option("header", True).csv(technical)
    pairs.repartitionByRange(4, "line").sortWithinPartitions("line").select("skill").write.text(keywords)
    return K.read_vocabulary(spark, technical, keywords).select(F.lower("skill").alias("key"), "skill")
