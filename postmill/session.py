"""Session settings, the shared folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when both limits hold.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "postmill", cores: int | str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Folders that local sessions without a setting made up, by application.
_MADE_UP: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``. Only a local session makes one up where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _MADE_UP.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # The setting belongs to the context and cannot be changed here.
        base = _MADE_UP[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="postmill-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/postmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` (reading at most ``max_rows + 1`` rows) against the broadcast limits."""
    width = F.lit(0)
    for field in df.schema.fields:
        if field.dataType.simpleString() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + F.lit(16)
        else:
            width = width + F.lit(16)
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """Hint a broadcast after measuring the side; a larger side keeps the shuffle join (AQE splits hot keys)."""
    return F.broadcast(df) if is_small(df, **limits) else df


_STORED: dict[tuple, str] = {}


def input_version(spark: SparkSession, folder: str) -> int:
    """A hash of the names, sizes and times of all files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return files.agg(F.coalesce(F.sum(F.pmod(one, F.lit(1 << 40))), F.lit(0))).first()[0]


def stored_once(spark: SparkSession, name: str, folder: str, write) -> str:
    """The path that ``write(path)`` filled from the files of ``folder``, once per application and version of these files."""
    key = (spark.sparkContext.applicationId, name, folder, input_version(spark, folder))
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]
