"""Rank-shaped operators that keep a hot key off any single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: Column, out: str) -> DataFrame:
    """Exact running total of ``weight`` within each key, in ``order`` (which must be unique within a key).

    Rows are range-partitioned by (key, order), so a key with a third of all rows is cut into many slices.
    Each slice is summed on its own and starts from the total of the slices before it. The ranged rows are
    checkpointed, because both the slices and their totals must see the same cut.
    """
    ranged = materialize(
        df.withColumn("_weight", weight)
        .repartitionByRange(*[F.col(name) for name in [*keys, *order]])
        .withColumn("_slice", F.spark_partition_id())
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum("_weight").over(within))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_slice")
        .agg(F.sum("_weight").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    starts = starts.select([F.col(name).alias(f"_k_{name}") for name in [*keys, "_slice"]] + ["_start"])
    same = F.lit(True)
    for name in [*keys, "_slice"]:
        same = same & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    return (
        local.join(starts, same)
        .withColumn(out, F.col("_local") + F.col("_start"))
        .drop("_weight", "_slice", "_local", "_start", *[f"_k_{name}" for name in [*keys, "_slice"]])
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """Row number within each key, from 1."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation at rank (n - 1) * p.

    Equal values are counted first; the positions come from a running total of the counts, so no task holds a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_total(counts, keys, [value], F.col("_n"), "_end").withColumn("_begin", F.col("_end") - F.col("_n"))
    # A NULL key is a group like any other.
    totals = placed.groupBy(*keys).agg(F.max("_end").alias("_total")).withColumnsRenamed({k: f"_t_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    placed = placed.join(totals, same)
    aggregates = []
    for name, p in points.items():
        rank = (F.col("_total") - 1) * F.lit(p)
        lower = F.floor(rank)
        upper = F.least(lower + 1, F.col("_total") - 1)
        for side, index in (("lo", lower), ("hi", upper)):
            here = (F.col("_begin") <= index) & (index < F.col("_end"))
            aggregates.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        aggregates.append(F.max(rank - lower).alias(f"_{name}_w"))
    found = placed.groupBy(*keys).agg(*aggregates)
    return found.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") * (1 - F.col(f"_{n}_w")) + F.col(f"_{n}_hi") * F.col(f"_{n}_w")).alias(n)
            for n in points
        ],
    )


def interleave(worklist: DataFrame, group: str, positions: DataFrame, item: list[str]) -> DataFrame:
    """Round-robin order: item 1 of each group in the configured group order, then item 2 of each, and so on.

    ``positions`` holds (group, position): the configured groups. Groups that are not configured drop out.
    """
    # The position comes along from the first join, which Spark may split or broadcast; no join follows the ranking.
    placed = ranked(worklist.join(positions, group), [group], item, "turn")
    return placed.orderBy("turn", "position")


def last_write_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key; partial aggregation collapses copies before the shuffle."""
    rest = [name for name in df.columns if name not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return latest.select(*keys, *[F.col("_row")[name].alias(name) for name in rest]).select(df.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key. Spark limits each key before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def rrf_fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, rank, posted_ts, optionally doc): score = sum of 1 / (k + rank).

    Rows without an id are skipped; ties go to the newer posting, then to the smaller id.
    """
    stacked = None
    for hits in lists:
        carried = [name for name in hits.columns if name == "doc"]
        part = hits.where(F.coalesce(F.col("id"), F.lit("")) != "").select(
            "id", "posted_ts", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), *carried
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    # A document's own columns are the same in every list.
    same = [F.any_value("doc").alias("doc")] if "doc" in stacked.columns else []
    fused = stacked.groupBy("id").agg(F.sum("score").alias("score"), F.max("posted_ts").alias("posted_ts"), *same)
    newest = F.coalesce(F.nullif(F.unix_seconds(F.col("posted_ts")), F.lit(0)), F.lit(-1))
    return fused.orderBy(F.col("score").desc(), newest.desc(), F.col("id").asc())
