"""Runs of the catalog as Parquet directories, their state log and the published pointer.

``root/<table>/run_id=<run>`` holds one table of one run and is written once. ``root/run_events`` and
``root/pointers`` are append-only; the current state of a run and the published run are folds of their rows, so
publishing is one appended row and readers never see half a run.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.quality import active_run, run_state

# The configured companies and their hosts, the default namespace.
COMPANIES = ["amazon", "apple", "google", "meta", "microsoft", "netflix"]
SCOPES = {
    "amazon": "www.amazon.jobs",
    "apple": "jobs.apple.com",
    "google": "www.google.com",
    "meta": "www.metacareers.com",
    "microsoft": "apply.careers.microsoft.com",
    "netflix": "explore.jobs.netflix.net",
}
NAMESPACE = "jobs_catalog"

TABLES = {
    "jobs": schemas.JOBS,
    "job_details": schemas.DETAILS,
    "companies": schemas.COMPANIES,
    "descriptions": schemas.DESCRIPTIONS,
}


class NotPublishable(Exception):
    """The run's tables or index are not ready."""


class NoPublishedRun(Exception):
    """No published run whose tables are ready."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- Tables of a run ---

    def _path(self, table: str, run_id: str) -> str:
        return f"{self.root}/{table}/run_id={run_id}"

    def write_run(self, table: str, run_id: str, df: DataFrame) -> None:
        """Write a table of a run once; a second write fails. Newest postings come first within each file."""
        df = df.drop("run_id")
        if table == "jobs":
            df = df.sortWithinPartitions(F.col("posted_ts").desc_nulls_last())
        df.write.mode("errorifexists").parquet(self._path(table, run_id))

    def scan_run(self, table: str, run_id: str, schema: StructType | None = None) -> DataFrame:
        """One table of one run. Only that run's directory is listed and read."""
        schema = schema or TABLES[table]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        return reader.parquet(self._path(table, run_id))

    def index_path(self, run_id: str) -> str:
        return f"{self.root}/index/{index_name(run_id)}"

    # --- State log ---

    def append_event(self, run_id: str, kind: str, **fields) -> None:
        now = datetime.now(timezone.utc)
        row = {"run_id": run_id, "seq": time.time_ns(), "kind": kind, "at": now, **fields}
        values = [row.get(name) for name in schemas.RUN_EVENTS.names]
        self.spark.createDataFrame([values], schemas.RUN_EVENTS).coalesce(1).write.mode("append").parquet(
            f"{self.root}/run_events")

    def states(self) -> DataFrame:
        """Current states: the event log, and each pointer row as the event that its run was published."""
        events = self.spark.read.schema(schemas.RUN_EVENTS).parquet(f"{self.root}/run_events")
        try:
            pointers = self.spark.read.schema(schemas.POINTERS).parquet(f"{self.root}/pointers")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return run_state(events)
        published = pointers.select(
            "run_id", (F.unix_micros("updated_at") * 1000).alias("seq"), F.lit("published").alias("kind"),
            F.col("updated_at").alias("at"),
        )
        return run_state(events.unionByName(published, allowMissingColumns=True))

    def state(self, run_id: str):
        return self.states().where(F.col("run_id") == run_id).first()

    def start_run(self, run_id: str, version_ts: datetime) -> None:
        self.append_event(run_id, "start", version_ts=version_ts)

    def set_tables_status(self, run_id: str, status: str, ready: bool, error: str | None = None) -> None:
        self.append_event(run_id, "db", status=status, db_ready=ready, db_error_message=error)

    def set_index_status(self, run_id: str, ready: bool, error: str | None = None, status: str | None = None) -> None:
        self.append_event(run_id, "es", status=status, es_ready=ready, es_error_message=error)

    # --- Publishing ---

    def publish(self, run_id: str, namespace: str = NAMESPACE) -> None:
        """Point the namespace at a run whose tables and index are ready; on failure mark the run failed."""
        state = self.state(run_id)
        if state is None or not (state["db_ready"] and state["es_ready"]):
            raise NotPublishable(run_id)
        # The row is the whole commit: pointer, dates and success appear together or not at all.
        row = [(namespace, run_id, datetime.now(timezone.utc))]
        try:
            self.spark.createDataFrame(row, schemas.POINTERS).coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")
        except Exception as exc:
            self.set_index_status(run_id, False, f"{type(exc).__name__}: {exc}", status="failed")
            raise

    def published_run(self, namespace: str = NAMESPACE) -> str:
        """Id of the published run; readers resolve it once and then use its immutable directories."""
        try:
            pointers = self.spark.read.schema(schemas.POINTERS).parquet(f"{self.root}/pointers")
            row = active_run(pointers, self.states(), namespace).first()
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            row = None
        if row is None:
            raise NoPublishedRun(namespace)
        return row["run_id"]


def index_name(run_id: str, prefix: str = "jobs-") -> str:
    """Lower-case run id with invalid characters as dashes."""
    import re

    cleaned = re.sub(r"[^a-z0-9._-]+", "-", run_id.strip().lower()).strip(".-")
    return prefix + (cleaned or "run")


def description_path(run_id: Column, company: Column, job_id: Column) -> Column:
    return F.concat(F.concat_ws("/", F.lit("job-details"), run_id, company, job_id), F.lit(".txt"))


def write_descriptions(catalog: Catalog, run_id: str, texts: DataFrame) -> DataFrame:
    """Store the texts of (company, external_job_id, description) rows; returns their details rows."""
    keyed = texts.withColumn(
        "job_description_path", description_path(F.lit(run_id), F.col("company"), F.col("external_job_id")))
    keyed.select("job_description_path", "description").write.mode("errorifexists").parquet(
        f"{catalog.root}/descriptions/run_id={run_id}")
    return keyed.select(F.lit(run_id).alias("run_id"), "company", "external_job_id", "job_description_path")


def stored_descriptions(catalog: Catalog, runs: list[str]) -> DataFrame:
    """(job_description_path, description) of the texts that were stored with some runs."""
    texts = None
    for run_id in runs:
        part = catalog.scan_run("descriptions", run_id).select("job_description_path", "description")
        texts = part if texts is None else texts.unionByName(part)
    return texts


def read_descriptions(catalog: Catalog, details: DataFrame, runs: list[str]) -> DataFrame:
    """Details with their text. A path that was carried forward points into an earlier run; a blank one gives NULL."""
    texts = stored_descriptions(catalog, runs)
    path = F.nullif(F.trim("job_description_path"), F.lit(""))
    with_path = details.withColumn("_path", path)
    found = with_path.where(F.col("_path").isNotNull()).join(
        texts.withColumnRenamed("job_description_path", "_path"), "_path", "left")
    without = with_path.where(F.col("_path").isNull()).withColumn("description", F.lit(None).cast("string"))
    return found.unionByName(without).drop("_path")


def stage_companies(requests: DataFrame, version_ts: Column) -> DataFrame:
    """Company rows of (run_id, companies) requests: the list is comma-separated text, unknown names are dropped,
    a blank list means all. Names keep their order in ``position``."""
    default = F.array(*[F.lit(c) for c in COMPANIES])
    named = F.filter(
        F.transform(F.split(F.coalesce("companies", F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    chosen = F.when(F.size(named) == 0, default).otherwise(F.filter(named, lambda x: x.isin(COMPANIES)))
    return requests.select("run_id", F.posexplode(F.array_distinct(chosen)).alias("position", "company")).select(
        "run_id", version_ts.alias("version_ts"), "company", F.initcap("company").alias("display_name"),
        version_ts.alias("updated_at"), "position",
    )


def write_index(catalog: Catalog, run_id: str, docs: DataFrame, docs_per_file: int = 1_000_000) -> int:
    """Write the search index of a run and check that it holds every document; the outcome goes to the state log."""
    from ..operators.search import SearchIndex

    path = catalog.index_path(run_id)
    try:
        counted = Observation()
        SearchIndex.of(docs.observe(counted, F.count(F.lit(1)).alias("n"))).write(path, docs_per_file)
        expected = counted.get["n"]
        stored = catalog.spark.read.parquet(f"{path}/docs").count()
        if stored != expected:
            raise ValueError(f"index of run {run_id} holds {stored} of {expected} documents")
        catalog.set_index_status(run_id, True)
        return stored
    except Exception as exc:
        catalog.set_index_status(run_id, False, f"{type(exc).__name__}: {exc}", status="failed")
        raise


def write_report_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A report as CSV with a header. Only reports of a few rows should be one file."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
