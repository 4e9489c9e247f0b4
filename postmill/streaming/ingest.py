"""Incremental ingest of postings: replayed events are dropped, each batch is one idempotent directory and one row of a commit log,
the current rows are the last writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ranking import last_write_wins


def read_stream(spark: SparkSession, path: str, schema: StructType, files: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def without_replays(stream: DataFrame, event_id: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows of events that have not come before, in this batch or in one whose events the watermark has not passed.

    The ids of the last ``delay`` of event time are kept, keyed, in the state store. A row that is later than that is dropped,
    which the query's progress counts.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(event_id)


def _commit_path(path: str) -> str:
    return f"{path}-commits"


def ingest(stream: DataFrame, keys: list[str], seq: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch, reduced to the last row of each key, to its own directory, and then its row of the commit log.

    A batch that is run again after a failure replaces its own directory unless its row is in the log; readers take the batches
    of the log alone, so they never see half a batch. No batch reads what earlier batches wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in committed(spark, path):
            return
        last_write_wins(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")
        row = spark.createDataFrame([(number,)], COMMIT).withColumn("committed_at", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").parquet(f"{_commit_path(path)}/commit={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


COMMIT = "batch bigint"


def committed(spark: SparkSession, path: str) -> set[int]:
    """The numbers in the commit log: one row per batch."""
    try:
        rows = spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(_commit_path(path))
        return {r["batch"] for r in rows.collect()}
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def _batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches, with the batch's number."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", path).option(
        "pathGlobFilter", "*.parquet").parquet(f"{path}/batch=*")
    return rows.where(F.col("batch").isin(sorted(committed(spark, path))))


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str], seq: str, upto: int) -> None:
    """Fold all batches up to number ``upto`` into one table, with the fold before it. Readers then skip those batches, whose
    directories may be removed later; a fold is written once, under its own number."""
    rows = _rows(spark, path, schema, upto)
    last_write_wins(rows, keys, seq).write.mode("overwrite").parquet(f"{path}-folds/upto={upto}")


def _rows(spark: SparkSession, path: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """The newest fold and the batches behind it."""
    batches = _batches(spark, path, schema)
    if upto is not None:
        batches = batches.where(F.col("batch") <= upto)
    try:
        folds = spark.read.schema(StructType([*schema.fields, StructField("upto", LongType())])).parquet(f"{path}-folds")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return batches.drop("batch")
    newest = folds.agg(F.max("upto")).first()[0]
    return folds.where(F.col("upto") == newest).drop("upto").unionByName(batches.where(F.col("batch") > newest).drop("batch"))


def current(spark: SparkSession, path: str, schema: StructType, keys: list[str], seq: str) -> DataFrame:
    """The last write of each key: over the newest fold and the batches that it does not hold."""
    return last_write_wins(_rows(spark, path, schema), keys, seq)
