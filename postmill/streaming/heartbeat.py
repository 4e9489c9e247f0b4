"""Counts of accepted and rejected events per time window and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Reasons, their codes, and the heartbeat interval.
REASONS = ["capacity", "blocked", "inuse", "duplicate", "invalid_capacity", "unknown"]
CODES = {1: "enqueued", 0: "capacity", -1: "blocked", -2: "inuse", -3: "duplicate", -4: "invalid_capacity"}
INTERVAL = "15 seconds"


def reason_of(code: Column) -> Column:
    out = F.lit("unknown")
    for number, reason in CODES.items():
        out = F.when(code == number, F.lit(reason)).otherwise(out)
    return out


def counts(events: DataFrame, interval: str = INTERVAL, delay: str | None = None, scoped: bool = True) -> DataFrame:
    """(window start, scope, accepted, rejected, rejected by reason) of (ts, scope, reason) events.

    With ``delay`` the table may be a stream: a window is emitted once, when the watermark has passed its end.
    """
    if delay is not None:
        events = events.withWatermark("ts", delay)
    keys = [F.window("ts", interval).alias("w"), *([F.col("scope")] if scoped else [])]
    accepted = F.col("reason") == "enqueued"
    known = F.col("reason").isin(REASONS)
    named = [
        F.count_if((F.col("reason") == r) if r != "unknown" else ~accepted & (~known | (F.col("reason") == r)))
        .alias(f"rejected_{r}")
        for r in REASONS
    ]
    totals = events.groupBy(*keys).agg(
        F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"), *named
    )
    return totals.select(F.col("w.start").alias("window_start"), *(["scope"] if scoped else []), "accepted", "rejected",
                         *[f"rejected_{r}" for r in REASONS])


def write_counts(stream: DataFrame, path: str, checkpoint: str, interval: str, delay: str | None = None, scoped: bool = True
                 ) -> StreamingQuery:
    """Without ``delay`` the stream has a watermark already."""
    return (
        counts(stream, interval, delay, scoped)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
