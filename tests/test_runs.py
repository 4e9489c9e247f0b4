import random
import statistics
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import merge as M
from postmill.operators import quality as Q
from postmill.operators import ranking as R
from postmill.operators import reports
from postmill.session import broadcast_if_small, is_small
from postmill.sources import catalog as C
from postmill.streaming import heartbeat, ingest, lease

KEYED = "run_id string, company string, external_job_id string"


# --- Ranking over hot keys ---------------------------------------------------------------------


def _hot(n=4000):
    """A third of all rows in one key."""
    rng = random.Random(5)
    return [("hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}", i, float(rng.randint(0, 300))) for i in range(n)]


def test_row_numbers_over_a_hot_key(spark):
    data = _hot()
    frame = spark.createDataFrame(data, "k string, i int, v double").repartition(6)
    got = sorted((r["k"], r["rn"], r["i"]) for r in R.ranked(frame, ["k"], ["i"]).collect())
    wanted = []
    for key in sorted({k for k, *_ in data}):
        wanted += [(key, n, i) for n, i in enumerate(sorted(i for k, i, _ in data if k == key), 1)]
    assert got == wanted


def test_exact_percentiles_over_a_hot_key(spark):
    data = _hot() + [("one", 0, 7.0), (None, 0, 1.0), (None, 1, 2.0)]
    frame = spark.createDataFrame(data, "k string, i int, v double").where("k is not null")
    got = {r["k"]: (r["p50"], r["p95"]) for r in
           R.exact_percentiles(frame, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    import numpy as np

    for key in {k for k, *_ in data if k}:
        values = [v for k, _, v in data if k == key]
        assert got[key] == pytest.approx((statistics.median(values), float(np.percentile(values, 95))))


def test_interleave(spark):
    work = spark.createDataFrame([("google", "g1"), ("amazon", "a2"), ("amazon", "a1"), ("other", "x")], "company string, id string")
    order = spark.createDataFrame([("amazon", 1), ("google", 2)], "company string, position int")
    got = [(r["company"], r["id"]) for r in R.interleave(work, "company", order, ["id"]).collect()]
    assert got == [("amazon", "a1"), ("google", "g1"), ("amazon", "a2")]


def test_pending_requests(spark):
    scraped = spark.createDataFrame([("amazon", "a2"), ("amazon", "a1"), ("amazon", "a1"), ("google", "g1")],
                                    "company string, external_job_id string")
    stored = spark.createDataFrame([("amazon", "a2"), ("other", "a1")], "company string, external_job_id string")
    got = {tuple(r) for r in M.pending_detail_requests(scraped, stored).collect()}
    assert got == {("amazon", "a1"), ("google", "g1")}


def test_broadcast_is_measured(spark):
    frame = spark.range(100).select(F.lit("x" * 100).alias("s"))
    assert is_small(frame) and not is_small(frame, max_rows=99) and not is_small(frame, max_bytes=5000)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(frame)) and "broadcast" not in plan(broadcast_if_small(frame, max_rows=9))


# --- Merges ------------------------------------------------------------------------------------


def test_upsert_jobs(spark):
    schema = f"{KEYED}, title string, skills array<string>, is_missing_details boolean, job_description_embedding array<float>"
    stored = spark.createDataFrame([("r", "a", "1", "old", ["x"], True, [1.0]), ("r", "a", "2", "keep", [], False, [])], schema)
    rows = spark.createDataFrame(
        [("r", "a", "1", "first", [" "], None, None, 1), ("r", "a", "1", "second", [], None, None, 2),
         ("r", "a", "3", "new", [" y ", ""], None, None, 3)], schema + ", seq int")
    got = {r["external_job_id"]: r for r in M.upsert_jobs(stored, rows, seq="seq").collect()}
    assert got["1"]["title"] == "second" and got["1"]["skills"] == ["x"]
    assert got["1"]["is_missing_details"] is False and got["1"]["job_description_embedding"] == [1.0]
    assert got["2"]["title"] == "keep" and got["3"]["skills"] == ["y"]
    assert len(got) == 3


# --- Gates -------------------------------------------------------------------------------------


def _counts(spark, **changes):
    base = {"company": "amazon", "expected_jobs": 1, "expected_details": 1, "jobs": 1, "missing_details": 0, "details": 1,
            "missing_description": 0, "missing_embedding": 0}
    return spark.createDataFrame([{**base, **changes}])


def test_gate(spark):
    assert Q.violations(_counts(spark)).count() == 0
    assert [r["rule"] for r in Q.violations(_counts(spark, jobs=0)).collect()] == [1, 2]
    broken = Q.violations(_counts(spark, details=0, missing_description=1, missing_embedding=1))
    assert sorted(r["rule"] for r in broken.collect()) == [2, 3, 4]
    carried = _counts(spark, expected_details=0)
    assert Q.violations(carried).count() == 0
    assert Q.violations(carried, mode="requests_only").count() == 1
    message = Q.failure_message(broken, ["company", "rule"]).first()["message"]
    assert message.startswith("company=amazon rule=details_count_mismatch expected=1 actual=0") and message.count(" | ") == 2


def test_error_rollup(spark):
    schema = "seq int, success boolean, error string"
    fine = spark.createDataFrame([(1, True, "ignored"), (2, False, "")], schema)
    assert tuple(Q.error_rollup(fine).first()) == ("in_progress", True, None, 0)
    bad = spark.createDataFrame([(i, False, f"e{i}") for i in range(9, 0, -1)], schema)
    state = Q.error_rollup(fine, bad, fine).first()
    assert tuple(state) == ("failed", False, "e1 | e2 | e3 | e4 | e5", 9)


# --- Reports -----------------------------------------------------------------------------------


def test_rank_configs_without_a_percentile(spark):
    summary = spark.createDataFrame([("a", 100.0, None), ("b", 100.0, 5.0), ("c", 50.0, 1.0)],
                                    "config_id string, success_rate_pct double, p95_latency_ms_success double")
    assert [r["config_id"] for r in reports.rank_configs(summary).collect()] == ["b", "a", "c"]


def test_task_status(spark):
    states = {"a": ["running", "failed"], "b": ["queued", "success"], "c": ["failed"], "d": ["success", "skipped"],
              "e": ["skipped"], "f": [None], "g": ["failed", "success"]}
    rows = [("d", "r", task, state, datetime(2026, 1, 1), None) for task, found in states.items() for state in found]
    tasks = spark.createDataFrame(rows, "dag_id string, run_id string, task_id string, state string, start_date timestamp, "
                                        "end_date timestamp")
    got = {r["task_id"]: (r["status"], r["duration_s"]) for r in
           reports.task_state_summary(tasks, F.lit("2026-01-01 00:01:00").cast("timestamp")).collect()}
    assert got == {"a": ("running", 60), "b": ("queued", 60), "c": ("failed", 60), "d": ("success", 60),
                   "e": ("skipped", 60), "f": ("pending", None), "g": ("mixed", 60)}


# --- Catalog -----------------------------------------------------------------------------------


def test_publish_state_machine(spark, tmp_path):
    catalog = C.Catalog(spark, str(tmp_path / "catalog"))
    with pytest.raises(C.NoPublishedRun):
        catalog.published_run()
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    catalog.start_run("r1", now)
    with pytest.raises(C.NotPublishable):
        catalog.publish("r1")
    catalog.set_tables_status("r1", "in_progress", True)
    catalog.set_index_status("r1", True)
    catalog.publish("r1")
    assert catalog.published_run() == "r1"
    state = catalog.state("r1")
    assert (state["status"], state["db_ready"], state["es_ready"]) == ("succeeded", True, True)
    assert state["db_published_at"] is not None and state["es_published_at"] is not None
    catalog.start_run("r2", now)
    catalog.set_tables_status("r2", "failed", False, "boom")
    assert catalog.published_run() == "r1"
    assert reports.failed_runs(catalog.states(), 5).select("run_id", "db_error_message").collect()[0] == ("r2", "boom")
    catalog.start_run("r1", now)
    state = catalog.state("r1")
    assert (state["status"], state["db_ready"], state["db_published_at"]) == ("in_progress", False, None)
    with pytest.raises(C.NoPublishedRun):
        catalog.published_run()


def test_runs_are_written_once(spark, tmp_path):
    catalog = C.Catalog(spark, str(tmp_path / "catalog"))
    companies = spark.createDataFrame([("r1", None, "amazon", "Amazon", None)], schemas.COMPANIES)
    catalog.write_run("companies", "r1", companies)
    catalog.write_run("companies", "r2", companies.limit(0))
    assert [r["run_id"] for r in catalog.scan_run("companies", "r1").collect()] == ["r1"]
    assert catalog.scan_run("companies", "r2").count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        catalog.write_run("companies", "r1", companies)


def test_index_name_and_companies(spark):
    assert C.index_name("Manual__2026-01-01T00:00:00+00:00") == "jobs-manual__2026-01-01t00-00-00-00-00"
    assert C.index_name(" ?? ") == "jobs-run"
    asked = spark.createDataFrame([("r1", " Netflix,amazon,other"), ("r2", " "), ("r3", "nobody")], "run_id string, companies string")
    got = [(r["run_id"], r["company"]) for r in C.stage_companies(asked, F.current_timestamp()).orderBy("run_id", "position").collect()]
    assert got == [("r1", "netflix"), ("r1", "amazon"), *[("r2", c) for c in C.COMPANIES]]


# --- Streams -----------------------------------------------------------------------------------


def test_ingest_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), i, f"v{i}") for i in range(200)]
    for n in range(5):
        spark.createDataFrame(rows[n * 40:(n + 1) * 40], "k int, seq int, v string").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    schema = spark.createDataFrame([], "k int, seq int, v string").schema
    for _ in range(2):  # a second run finds nothing new
        stream = ingest.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        ingest.ingest(stream, ["k"], "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["k"]: r["v"] for r in ingest.current(spark, str(tmp_path / "out"), schema, ["k"], "seq").collect()}
    assert got == {k: v for k, _, v in rows}
    for upto in (1, 3):
        ingest.compact(spark, str(tmp_path / "out"), schema, ["k"], "seq", upto)
        found = {r["k"]: r["v"] for r in ingest.current(spark, str(tmp_path / "out"), schema, ["k"], "seq").collect()}
        assert found == got


def _step(state, event):
    """The rules for one event of one resource."""
    status, token, until = state
    if status in ("inuse", "blocked") and event.ts >= until:
        status, token, until = "missing", None, None
    if event.action == "lease":
        return "inuse", event.token, event.ts + lease.LEASE_TTL
    if event.action == "enqueue":
        return ("available", None, None) if status == "missing" else (status, token, until)
    if status == "inuse" and event.token == token:
        return ("available", None, None) if event.action == "return" else ("blocked", None, event.ts + lease.BLOCK_TTL)
    return status, token, until


def test_lease_stream_equals_batch_and_a_plain_machine(spark, tmp_path):
    rng = random.Random(4)
    events = []
    for i in range(900):
        resource = "hot" if rng.random() < 0.33 else f"x{rng.randint(0, 12)}"
        events.append(("s", resource, 1000 + i * 10, i, rng.choice(["enqueue", "lease", "return", "block"]), f"t{rng.randint(0, 1)}"))
    schema = "scope string, resource string, ts long, seq long, action string, token string"
    for n in range(3):
        spark.createDataFrame(events[n * 300:(n + 1) * 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(events, schema)
    stream = ingest.read_stream(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    lease.track(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    plain = {}
    for event in frame.collect():
        plain[event.resource] = _step(plain.get(event.resource, ("missing", None, None)), event)
    for as_of in (10000, 10200, 10900):
        at = F.lit(as_of)
        batch = {r["resource"]: r["state"] for r in lease.lease_states(frame, at).collect()}
        streamed = {r["resource"]: r["state"] for r in lease.tracked_states(spark, str(tmp_path / "out"), at).collect()}
        wanted = {k: "missing" if s in ("inuse", "blocked") and until <= as_of else s for k, (s, _, until) in plain.items()}
        assert batch == wanted and streamed == wanted


LEASE = "scope string, resource string, ts long, seq long, action string, token string"


def _lease_parts(spark, tmp_path, parts, **options):
    """The stream runs to its end after each part, and goes on from its checkpoint with the next one."""
    for rows in parts:
        spark.createDataFrame(rows, LEASE).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], LEASE).schema)
        lease.track(stream, str(tmp_path / "out"), str(tmp_path / "cp"), **options).awaitTermination()


def test_lease_stream_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(6)
    events = [("s", f"x{rng.randint(0, 20)}", 1000 + i * 10, i, rng.choice(["enqueue", "lease", "return", "block"]),
               f"t{rng.randint(0, 1)}") for i in range(1200)]
    # Many files in any order; an event comes at most 200 s late.
    events.sort(key=lambda e: e[2] + rng.randint(0, 200))
    _lease_parts(spark, tmp_path, [events[:300], events[300:700], events[700:]], delay=300)
    frame = spark.createDataFrame(events, LEASE)
    for as_of in (13000, 13200, 14000):
        whole = sorted(map(tuple, lease.lease_states(frame, F.lit(as_of)).collect()))
        assert whole == sorted(map(tuple, lease.tracked_states(spark, str(tmp_path / "out"), F.lit(as_of)).collect()))


def test_a_batch_touches_its_own_resources_and_timers_let_them_expire(spark, tmp_path):
    many = [("s", f"x{i}", 1000, i, "lease", "k") for i in range(50)]
    _lease_parts(spark, tmp_path, [many, [("s", "x7", 1100, 60, "return", "k")]], delay=10)
    rows = spark.read.schema(f"{lease.TRACKED}, batch long").parquet(str(tmp_path / "out"))
    touched = {r["batch"]: r["n"] for r in rows.where("timer = 0").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sorted(touched.values()) == [1, 50]
    assert {r["state"] for r in lease.tracked(spark, str(tmp_path / "out")).where("resource <> 'x7'").collect()} == {"inuse"}
    # An event of another resource moves the watermark past the end of the leases: they expire, and their state goes.
    _lease_parts(spark, tmp_path, [[("s", "other", 5000, 70, "enqueue", None)]], delay=10)
    states = {r["resource"]: r["state"] for r in lease.tracked(spark, str(tmp_path / "out")).collect()}
    assert states == {**{f"x{i}": "missing" for i in range(50)}, "x7": "available", "other": "available"}
    held = spark.read.format("statestore").option("stateVarName", "settled").load(str(tmp_path / "cp"))
    assert {r["key"]["resource"] for r in held.collect()} <= {"x7", "other"}


class _Counted:
    """A handle with one value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, *_):
        return self

    def registerTimer(self, _):
        self.calls.append("timer")

    def getCurrentWatermarkInMs(self):
        return 10_000_000

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_a_resource_costs_one_read_and_one_write_a_batch():
    handle, tracker = _Counted(), lease.LeaseTracker(lease.LEASE_TTL, lease.BLOCK_TTL)
    tracker.init(handle)
    events = [{"ts": 1000 + i, "seq": i, "action": "lease", "token": "k"} for i in range(5)]
    for _ in range(2):
        handle.calls.clear()
        list(tracker.handleInputRows(("s", "x"), events, handle))
        assert sorted(handle.calls) == ["get", "timer", "update"]
    handle.calls.clear()
    list(tracker.handleExpiredTimer(("s", "x"), handle, None))
    assert handle.calls == ["get", "clear"] and handle.value is None


def test_lease_summary_steps_are_the_batch_rules(spark):
    rng = random.Random(9)
    events = [("s", f"x{i % 40}", 1000 + i * 25, i, rng.choice(["enqueue", "lease", "return", "block"]), rng.choice(["a", "b", None]))
              for i in range(600)]
    for as_of in (9000, 16000, 30000):
        got = {}
        for _, name, ts, seq, action, token in events:
            got.setdefault(name, lease.Summary()).add(ts, seq, action, token, lease.LEASE_TTL)
        states = {n: m.state(as_of, lease.LEASE_TTL, lease.BLOCK_TTL) for n, m in got.items()}
        frame = spark.createDataFrame(events, LEASE)
        assert {r["resource"]: r["state"] for r in lease.lease_states(frame, F.lit(as_of)).collect()} == states


def test_ingest_of_replayed_and_late_files(spark, tmp_path):
    rng = random.Random(5)
    schema = "event_id long, k int, v string, event_time timestamp"
    rows = [(i, rng.randint(0, 9), f"v{i}", datetime.fromtimestamp(1_700_000_000 + 10 * i, timezone.utc)) for i in range(400)]
    late = sorted(rows, key=lambda r: r[3].timestamp() + rng.randint(0, 500))
    path, counted = str(tmp_path / "out"), []
    for part in (late[:150], late[100:250], late[:150], late[250:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        once = ingest.without_replays(stream, ["event_id"], "event_time", "600 seconds")
        query = ingest.ingest(once, ["event_id"], "event_id", path, str(tmp_path / "cp"))
        query.awaitTermination()
        counted.append(spark.read.schema(schema).parquet(f"{path}/batch=*").count())
    # Each event was written once; replays added nothing.
    assert counted == [150, 250, 250, 400]
    got = {r["event_id"]: r["v"] for r in ingest.current(spark, path, spark.createDataFrame([], schema).schema, ["event_id"], "event_id").collect()}
    assert got == {i: v for i, _, v, _ in rows}


def test_batches_outside_the_commit_log_are_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k int, seq int, v string").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = ingest.read_stream(spark, str(tmp_path / "in"), schema)
    ingest.ingest(stream, ["k"], "seq", path, str(tmp_path / "cp")).awaitTermination()
    # A batch that failed before its commit.
    spark.createDataFrame([(1, 9, "half")], "k int, seq int, v string").write.parquet(f"{path}/batch=7")
    assert ingest.committed(spark, path) == {0}
    assert {r["k"]: r["v"] for r in ingest.current(spark, path, schema, ["k"], "seq").collect()} == {1: "b", 2: "c"}


def test_lease_stream_with_late_events(spark, tmp_path):
    """Events come out of order within the bound: the stream still equals the whole log."""
    rng = random.Random(8)
    events = []
    for i in range(800):
        events.append(("s", f"x{rng.randint(0, 9)}", 1000 + i * 10, i, rng.choice(["enqueue", "lease", "return", "block"]), f"t{rng.randint(0, 1)}"))
    schema = "scope string, resource string, ts long, seq long, action string, token string"
    late = sorted(events, key=lambda e: e[2] + rng.randint(0, 900))
    late[0:0] = [("s", "y", 1110, 5000, "return", "k")]
    late.insert(300, ("s", "y", 1100, 4999, "lease", "k"))
    for n in range(4):
        spark.createDataFrame(late[n * 200:(n + 1) * 200 + (n == 3) * 9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(late, schema)
    stream = ingest.read_stream(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    lease.track(stream, str(tmp_path / "out"), str(tmp_path / "cp"), delay=9000).awaitTermination()
    for as_of in (1200, 5000, 9100):
        at = F.lit(as_of)
        whole = sorted(map(tuple, lease.lease_states(frame, at).collect()))
        assert whole == sorted(map(tuple, lease.tracked_states(spark, str(tmp_path / "out"), at).collect()))
    assert ("s", "y", "available") in whole


def test_readiness_is_judged_by_run(spark):
    states = spark.createDataFrame([("r1", True, True), ("r2", True, True), ("r3", True, False)], "run_id string, db_ready boolean, es_ready boolean")
    broken = Q.violations(_counts(spark, jobs=0).withColumn("run_id", F.lit("r1")))
    assert {r["run_id"]: r["publishable"] for r in Q.readiness(states, broken).collect()} == {"r1": False, "r2": True, "r3": False}


def test_a_failed_publish_is_never_seen(spark, tmp_path, monkeypatch):
    catalog = C.Catalog(spark, str(tmp_path / "catalog"))
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    for run in ("r1", "r2"):
        catalog.start_run(run, now)
        catalog.set_tables_status(run, "in_progress", True)
        catalog.set_index_status(run, True)
    catalog.publish("r1")
    # Nothing is written after the pointer row, so only the write of the row itself can fail.
    monkeypatch.setattr(C.schemas, "POINTERS", schemas.COMPANIES)
    with pytest.raises(Exception):
        catalog.publish("r2")
    monkeypatch.undo()
    assert catalog.published_run() == "r1"
    assert catalog.state("r2")["status"] == "failed" and catalog.state("r1")["status"] == "succeeded"


def test_null_keys_are_groups(spark):
    from postmill.operators.ranking import exact_percentiles

    frame = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["p"] for r in exact_percentiles(frame, ["k"], "v", {"p": 0.5}).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_heartbeat_reasons(spark):
    rows = [(datetime(2026, 1, 1, 0, 0, s), "a", r) for s, r in
            [(1, "enqueued"), (2, "capacity"), (14, "unknown"), (3, "other"), (16, "blocked")]]
    frame = spark.createDataFrame(rows, "ts timestamp, scope string, reason string")
    got = heartbeat.counts(frame).orderBy("window_start").collect()
    assert [(r["accepted"], r["rejected"], r["rejected_capacity"], r["rejected_unknown"], r["rejected_blocked"]) for r in got] == [
        (1, 3, 1, 2, 0), (0, 1, 0, 0, 1)]
    assert heartbeat.counts(frame, scoped=False).count() == 2
