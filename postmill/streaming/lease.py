"""State of leased resources from their event log, in batch and as a stream.

Events: (scope, resource, ts, seq, action, token). ``enqueue`` makes a missing resource available. ``lease`` puts it
in use under a token until it expires. ``return`` and ``block`` count only with the token of the running lease; a
return makes it available, a block keeps it away until the block expires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Default lifetimes in seconds.
LEASE_TTL = 300
BLOCK_TTL = 900
# Seconds that an event may come behind a newer one.
LATE = 3600

KEY = ["scope", "resource"]


def lease_summary(events: DataFrame, lease_ttl: int = LEASE_TTL) -> DataFrame:
    """(scope, resource, enqueued, lease, end): the last enqueue, the last lease and the first valid end of that lease.

    Only the last lease of a resource can still hold, so nothing else is needed. All three are aggregates that
    combine before the shuffle: no task orders, or holds, the history of a resource.
    """
    is_lease = F.col("action") == "lease"
    last = events.groupBy(*KEY).agg(
        F.max(F.when(F.col("action") == "enqueue", F.col("ts"))).alias("enqueued"),
        F.max(F.when(is_lease, F.struct("ts", "seq", "token"))).alias("lease"),
    )
    ends = events.where(F.col("action").isin("return", "block")).join(
        last.where(F.col("lease").isNotNull()).select(*KEY, "lease"), KEY
    )
    valid = (
        (F.struct("ts", "seq") > F.struct("lease.ts", "lease.seq"))
        & (F.col("token") == F.col("lease.token"))
        & (F.col("ts") < F.col("lease.ts") + lease_ttl)
    )
    first = ends.where(valid).groupBy(*KEY).agg(F.min(F.struct("ts", "seq", "action")).alias("end"))
    return last.join(first, KEY, "left")


def state_of(summary: DataFrame, as_of: Column, lease_ttl: int = LEASE_TTL, block_ttl: int = BLOCK_TTL) -> DataFrame:
    """(scope, resource, state) at ``as_of`` (epoch seconds): available, inuse, blocked or missing."""
    returned, blocked = F.col("end.action") == "return", F.col("end.action") == "block"
    free_at = F.when(blocked, F.col("end.ts") + block_ttl).otherwise(F.col("lease.ts") + lease_ttl)
    state = (
        F.when(F.col("lease").isNull(), F.when(F.col("enqueued").isNotNull(), "available").otherwise("missing"))
        .when(returned, "available")
        .when(F.col("enqueued") >= free_at, "available")
        .when(as_of < free_at, F.when(blocked, "blocked").otherwise("inuse"))
        .otherwise("missing")
    )
    return summary.select(*KEY, state.alias("state"))


def lease_states(events: DataFrame, as_of: Column, lease_ttl: int = LEASE_TTL, block_ttl: int = BLOCK_TTL) -> DataFrame:
    return state_of(lease_summary(events, lease_ttl), as_of, lease_ttl, block_ttl)


# --- The stream -------------------------------------------------------------------------------

# Fixed value: the state store that keeps keys on disk, so the number of resources is not bounded by memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SUMMARY = "enqueued bigint, lease_ts bigint, lease_seq bigint, lease_token string, end_ts bigint, end_seq bigint, end_action string"
EVENT = "ts: bigint, seq: bigint, action: string, token: string"
TRACKED = f"scope string, resource string, {SUMMARY}, state string, timer int"
COLUMNS = [field.split()[0] for field in TRACKED.split(", ")]


class Summary:
    """What one resource's events have led to, in the order of (ts, seq)."""

    def __init__(self, values=(None,) * 7):
        self.enqueued, self.lease_ts, self.lease_seq, self.lease_token, self.end_ts, self.end_seq, self.end_action = values

    def values(self) -> tuple:
        return (self.enqueued, self.lease_ts, self.lease_seq, self.lease_token, self.end_ts, self.end_seq, self.end_action)

    def add(self, ts: int, seq: int, action: str, token: str | None, lease_ttl: int) -> None:
        if action == "enqueue":
            self.enqueued = ts if self.enqueued is None else max(ts, self.enqueued)
        elif action == "lease":
            self.lease_ts, self.lease_seq, self.lease_token = ts, seq, token
            self.end_ts = self.end_seq = self.end_action = None
        elif (
            action in ("return", "block") and self.lease_ts is not None and self.end_action is None
            and token is not None and token == self.lease_token and ts < self.lease_ts + lease_ttl
        ):
            self.end_ts, self.end_seq, self.end_action = ts, seq, action

    def free_at(self, lease_ttl: int, block_ttl: int) -> int:
        """When the last lease or its block is over."""
        if self.end_action == "return":
            return self.end_ts
        return self.end_ts + block_ttl if self.end_action == "block" else self.lease_ts + lease_ttl

    def state(self, as_of: int, lease_ttl: int, block_ttl: int) -> str:
        if self.lease_ts is None:
            return "missing" if self.enqueued is None else "available"
        free_at = self.free_at(lease_ttl, block_ttl)
        if self.end_action == "return" or (self.enqueued is not None and self.enqueued >= free_at):
            return "available"
        if as_of < free_at:
            return "blocked" if self.end_action == "block" else "inuse"
        return "missing"


class LeaseTracker(StatefulProcessor):
    """The state of one resource: what its settled events led to, and the events that a late one may still come before.

    A timer at an event's time settles it when the watermark has passed; one at the end of a lease or block lets it expire. An
    expired resource that is not available has no state any more.
    """

    def __init__(self, lease_ttl: int, block_ttl: int):
        self.lease_ttl, self.block_ttl = lease_ttl, block_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, so a resource costs one read and one write, each of which leaves the worker.
        self.held = handle.getValueState("settled", f"{SUMMARY}, pending array<struct<{EVENT}>>")

    def _read(self) -> tuple[Summary, list[tuple]]:
        """What the settled events led to, and the others in their order."""
        value = self.held.get()
        if value is None:
            return Summary(), []
        *settled, pending = value
        return Summary(settled), sorted((tuple(e) for e in pending or ()), key=lambda e: (e[0], e[1]))

    def _write(self, settled: Summary, pending: list[tuple]) -> None:
        self.held.update((*settled.values(), pending))

    def _row(self, key, summary: Summary, watermark: int, timer: int) -> Row:
        state = summary.state(max(0, watermark) // 1000, self.lease_ttl, self.block_ttl)
        return Row(**dict(zip(COLUMNS, (*key, *summary.values(), state, timer))))

    def handleInputRows(self, key, rows, timerValues):
        new = [(r["ts"], r["seq"], r["action"], r["token"]) for r in rows]
        # One timer for what came together.
        self.handle.registerTimer(max(e[0] for e in new) * 1000)
        summary, before = self._read()
        self._write(summary, before + new)
        for event in sorted(before + new, key=lambda e: (e[0], e[1])):
            summary.add(*event, self.lease_ttl)
        yield self._row(key, summary, timerValues.getCurrentWatermarkInMs(), 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        settled, events = self._read()
        due = [e for e in events if e[0] * 1000 <= watermark]
        rest = events[len(due):]
        for event in due:
            settled.add(*event, self.lease_ttl)
        whole = Summary(settled.values())
        for event in rest:
            whole.add(*event, self.lease_ttl)
        yield self._row(key, whole, watermark, 1)
        if settled.lease_ts is not None:
            free_at = settled.free_at(self.lease_ttl, self.block_ttl)
            if free_at * 1000 > watermark:
                self.handle.registerTimer(free_at * 1000)
            else:
                # Over: only that the resource is available, if it is, can still matter.
                there = settled.state(free_at, self.lease_ttl, self.block_ttl) == "available"
                settled = Summary((max(settled.enqueued or free_at, free_at) if there else None, *(None,) * 6))
        if rest or any(v is not None for v in settled.values()):
            self._write(settled, rest)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def track(stream: DataFrame, path: str, checkpoint: str, lease_ttl: int = LEASE_TTL, delay: int = LATE,
          block_ttl: int = BLOCK_TTL) -> StreamingQuery:
    """Keep the state of each resource, keyed, in the state store; batch n writes the resources that it touched to its own folder.

    The result equals that of the whole log as long as no event comes more than ``delay`` seconds (of event time) behind a
    newer one; a later one is dropped. A key holds its summary and the events of the last ``delay`` seconds. A batch that is run
    again replaces its own folder. States are asked for at times that the watermark has not passed.
    """
    spark = stream.sparkSession
    # Others of the key columns' names stay out of the state.
    events = stream.select(
        *[F.col(k).cast("string") for k in KEY], F.col("ts").cast("bigint"), F.col("seq").cast("bigint"), "action",
        F.col("token").cast("string"), F.timestamp_seconds("ts").alias("event_time"),
    ).where(F.col("ts").isNotNull()).withWatermark("event_time", f"{delay} seconds")
    states = events.groupBy(*KEY).transformWithState(
        LeaseTracker(lease_ttl, block_ttl), outputStructType=TRACKED, outputMode="Update", timeMode="EventTime"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    # A query keeps the settings that it started with.
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            states.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def tracked(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each tracked resource; its ``state`` is that at the watermark of its batch."""
    rows = spark.read.schema(f"{TRACKED}, batch bigint").parquet(path)
    rest = [c for c in rows.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct("batch", "timer")).alias("newest")
    return rows.groupBy(*KEY).agg(newest).select(*KEY, "newest.*").drop("timer")


def tracked_states(spark: SparkSession, path: str, as_of: Column, lease_ttl: int = LEASE_TTL, block_ttl: int = BLOCK_TTL
                   ) -> DataFrame:
    """(scope, resource, state) at ``as_of`` from the newest rows."""
    summary = tracked(spark, path).select(
        *KEY, "enqueued",
        F.when(F.col("lease_ts").isNotNull(), F.struct(
            F.col("lease_ts").alias("ts"), F.col("lease_seq").alias("seq"), F.col("lease_token").alias("token"))).alias("lease"),
        F.when(F.col("end_action").isNotNull(), F.struct(
            F.col("end_ts").alias("ts"), F.col("end_seq").alias("seq"), F.col("end_action").alias("action"))).alias("end"),
    )
    return state_of(summary, as_of, lease_ttl, block_ttl)
