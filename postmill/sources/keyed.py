"""Tables that change by key: a base bucketed by the key, small change files, and both merged when read.

The base is stored in buckets, sorted by key. A mutation writes its rows as one more change file and reads nothing. A reader joins
the base with the changes that are not folded yet: the changes are shuffled into the base's buckets, the base is read where it
lies, so the cost of a mutation follows the size of the change. ``fold`` writes the merged rows as the next base; a row of the
version log, appended last, makes it current, so readers see the one or the other.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_strings
from ..operators.merge import Rule, fill_missing, keep_unless_empty
from ..operators.ranking import last_write_wins

VERSIONS = "version bigint, folded_upto bigint"


def take_new(stored: Column, new: Column) -> Column:
    return new


def set_true(stored: Column, new: Column) -> Column:
    return F.lit(True)


@dataclass
class Kind:
    """A mutation: the rule of each column that it sets, and whether it inserts keys that are not there."""

    rules: dict[str, Rule]
    inserts: bool = False


# The mutations of postings; see ``operators.merge`` for the same rules on whole tables.
_PAYLOAD = (
    "version_ts", "title", "job_type", "job_level", "details_url", "apply_url", "locations", "posted_ts", "updated_at",
)
JOB_KINDS = {
    "upsert": Kind({**dict.fromkeys(_PAYLOAD, take_new), "skills": keep_unless_empty, "is_missing_details": take_new}, inserts=True),
    "mark_missing": Kind({"is_missing_details": set_true}),
    "fill_posted_ts": Kind({"posted_ts": fill_missing}),
    "features": Kind({"skills": take_new, "job_description_embedding": take_new}),
}


@dataclass
class KeyedTable:
    """A table below ``path`` with unique ``keys``; ``kinds`` are its mutations."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    kinds: dict[str, Kind]
    buckets: int = 200
    name: str = field(default="")

    def __post_init__(self):
        self.values = [f for f in self.schema.fields if f.name not in self.keys]
        self.name = self.name or f"keyed_{zlib.crc32(self.path.encode()):08x}"

    # --- Storage ---

    def _log(self) -> DataFrame:
        return self.spark.read.schema(VERSIONS).option("recursiveFileLookup", "true").parquet(f"{self.path}/versions")

    def current(self) -> tuple[int, int]:
        """(version of the base, number of the last change that it holds)."""
        row = self._log().agg(F.max(F.struct("version", "folded_upto")).alias("v")).first()["v"]
        return row["version"], row["folded_upto"]

    def _write_base(self, rows: DataFrame, version: int, upto: int) -> None:
        (
            rows.select(*[f.name for f in self.schema.fields])
            .repartition(self.buckets, *self.keys)
            .write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet")
            .option("path", f"{self.path}/base-{version}").mode("overwrite").saveAsTable(f"{self.name}_{version}")
        )
        self.spark.createDataFrame([(version, upto)], VERSIONS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/versions/version={version}")

    def create(self, rows: DataFrame) -> KeyedTable:
        self._write_base(rows, 0, 0)
        return self

    def base(self, version: int) -> DataFrame:
        """The stored base; a new application learns of its buckets first."""
        table = f"{self.name}_{version}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            names = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({names}) SORTED BY ({names}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/base-{version}'")
        return self.spark.table(table)

    def _change_schema(self) -> T.StructType:
        by_name = {f.name: f for f in self.schema.fields}
        return T.StructType([
            *[T.StructField(k, by_name[k].dataType) for k in self.keys], T.StructField("kind", T.StringType()),
            T.StructField("row", self._row_type()), T.StructField("number", T.LongType()),
        ])

    def _row_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in self.values])

    def pending(self, after: int) -> DataFrame:
        """The changes behind number ``after``."""
        schema = self._change_schema()
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/changes")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return rows.where(F.col("number") > after)

    # --- Mutations ---

    def change(self, kind: str, rows: DataFrame, number: int, seq: str | None = None) -> None:
        """Write the rows of a mutation as change ``number`` (ascending). Written again, it replaces itself.

        ``seq`` orders copies of a key: the last one counts. Without it keys are unique, or any one of equal keys counts.
        """
        known = self.kinds[kind].rules
        lacking = [c for c, rule in known.items() if rule is not set_true and c not in rows.columns]
        if lacking:
            raise ValueError(f"a change of kind {kind} needs the columns {', '.join(lacking)}")
        if seq is not None:
            rows = last_write_wins(rows, self.keys, seq).drop(seq)
        else:
            rows = rows.dropDuplicates(self.keys)
        row = F.struct(*[
            (F.col(f.name) if f.name in rows.columns and (f.name in known or self.kinds[kind].inserts) else F.lit(None))
            .cast(_nullable(f.dataType)).alias(f.name) for f in self.values
        ])
        rows.select(*self.keys, F.lit(kind).alias("kind"), row.alias("row")).write.mode("overwrite").parquet(
            f"{self.path}/changes/number={number}")

    # --- Reading ---

    def read(self) -> DataFrame:
        """The base with all changes that it does not hold, applied in the order of their numbers."""
        version, upto = self.current()
        kind = self._row_type()
        # One entry per change file that is not folded.
        changes = self.pending(upto).groupBy(*self.keys).agg(
            F.sort_array(F.collect_list(F.struct("number", "kind", "row"))).alias("_changes"))
        base = self.base(version).select(
            *self.keys, F.struct(*[F.col(f.name).cast(_nullable(f.dataType)).alias(f.name) for f in self.values]).alias("_stored"))
        joined = base.join(changes, self.keys, "full_outer")
        applied = F.when(F.col("_changes").isNull(), F.col("_stored")).otherwise(
            F.aggregate("_changes", F.col("_stored").cast(kind), lambda stored, c: self._apply(stored, c).cast(kind)))
        merged = joined.select(*self.keys, applied.alias("_row")).where(F.col("_row").isNotNull())
        return merged.select(*[F.col(f.name) if f.name in self.keys else F.col(f"_row.{f.name}") for f in self.schema.fields])

    def _apply(self, stored: Column, change: Column) -> Column:
        out = stored
        for name, kind in self.kinds.items():
            new = change["row"]
            both = F.struct(*[
                (kind.rules[f.name](stored[f.name], new[f.name]) if f.name in kind.rules else stored[f.name])
                .cast(_nullable(f.dataType)).alias(f.name) for f in self.values
            ])
            value = F.when(stored.isNotNull(), both)
            if kind.inserts:
                value = value.otherwise(new)
            out = F.when(change["kind"] == name, value).otherwise(out)
        return out

    def fold(self) -> int:
        """Write the merged rows as the next base; its number. Change files up to there may be removed later."""
        version, upto = self.current()
        newest = self.pending(upto).agg(F.max("number").alias("n")).first()["n"]
        if newest is None:
            return version
        self._write_base(self.read(), version + 1, newest)
        return version + 1


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere inside."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    return kind


def job_table(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 200) -> KeyedTable:
    return KeyedTable(spark, path, schema, keys, JOB_KINDS, buckets)


def upsert_jobs(table: KeyedTable, rows: DataFrame, number: int, seq: str | None = None) -> None:
    """New payloads win; stored skills survive an empty list; the missing flag is reset; embeddings are not touched."""
    fresh = rows.withColumns({"is_missing_details": F.lit(False), "skills": clean_strings(F.col("skills"))})
    table.change("upsert", fresh.drop("job_description_embedding"), number, seq)


def mark_missing(table: KeyedTable, missing: DataFrame, number: int) -> None:
    table.change("mark_missing", missing.select(*table.keys), number)


def fill_posted_ts(table: KeyedTable, dated: DataFrame, number: int) -> None:
    table.change("fill_posted_ts", dated.where(F.col("posted_ts").isNotNull()), number)


def apply_features(table: KeyedTable, features: DataFrame, number: int) -> None:
    """Set skills and embedding; a blank description gives an empty list and an empty vector."""
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    empty = F.array().cast("array<string>")
    table.change("features", features.select(
        *table.keys, F.when(blank, empty).otherwise(clean_strings(F.col("skills"))).alias("skills"),
        F.when(blank, F.array().cast("array<float>")).otherwise(F.coalesce("embedding", F.array().cast("array<float>")))
        .alias("job_description_embedding"),
    ), number)
