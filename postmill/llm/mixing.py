"""Mixing sources to target weights by capped water-filling.

Sources in code point order (null last) get the weights in turn and share ``share`` times all words in proportion.
A source that would be repeated more than ``cap`` times is clamped there, and its excess goes to the others by
weight until none is above. Each source then takes every document ``floor(target / size)`` times, and for the
remaining fraction of a repetition whole documents in a seeded order; the one document on the edge gives the words
that are still missing.

No task holds a source: the seeded order is cut into buckets (a prefix of the document's hash), sizes are summed per
source and bucket, and only the bucket on the edge is ordered row by row. Everything is built-in expressions.

Defined results: a null text has size 0; a null source is a source of its own; rows with one doc_id (or a null one) stand
at the same place of the order and share what the edge leaves in proportion to their sizes. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..session import broadcast_if_small, materialize
from .carry import carry, put_back

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
# Hexadecimal digits of the seeded hash that make a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _fill_level(sources: DataFrame, amount: float) -> float:
    """Words per unit of weight, so that the clamped targets add up to ``amount``."""
    level, clamped_before = 0.0, None
    while True:
        above = F.col("_cap") <= F.lit(level) * F.col("_weight")
        clamped, words, weight = sources.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_weight")))
        ).first()
        if clamped == clamped_before or not weight:
            return level
        level, clamped_before = (amount - (words or 0)) / weight, clamped


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """One row per source: ``_source``, ``source_size``, ``target``, ``_whole`` (whole repetitions), ``_rest`` (words beyond)."""
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("source_size")).select(
        "*", F.lit(0).alias("_all"), F.col("_source").isNull().alias("_last"), F.coalesce("_source", F.lit("")).alias("_name")
    )
    numbered = ranked(totals, ["_all"], ["_last", "_name"], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    sources = materialize(
        numbered.select(
            "_source", "source_size", (F.col("source_size") * cap).alias("_cap"),
            F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("bigint").alias("_weight"),
        )
    )
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _fill_level(sources, share * everything)
    words = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.expr("floor(target) div source_size"))).otherwise(F.lit(0))
    return (
        sources.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight")))
        .withColumn("_whole", whole.cast("bigint"))
        .withColumn("_rest", (words - F.col("_whole") * F.col("source_size")).cast("bigint"))
        .drop("_cap", "_weight")
    )


def _edges(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the place where the fractional repetition ends: ``_edge`` key, words left there and words at that key."""
    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    upto = Window.partitionBy("_source").orderBy("_bucket")
    buckets = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_words"))
    buckets = buckets.withColumn("_end", F.sum("_words").over(upto))
    joined = buckets.alias("b").join(
        targets.select(F.col("_source").alias("_s"), "_rest"), F.col("_source").eqNullSafe(F.col("_s"))
    )
    last = joined.where(
        (F.col("_end") > F.col("_rest")) & (F.col("_end") - F.col("_words") <= F.col("_rest"))
    ).select("_s", F.col("_bucket").alias("_b"), (F.col("_rest") - F.col("_end") + F.col("_words")).alias("_left"))
    inside = sized.join(
        broadcast_if_small(last), F.col("_source").eqNullSafe(F.col("_s")) & (bucket == F.col("_b"))
    )
    keys = inside.groupBy("_source", "_key").agg(F.sum("_size").alias("_words"), F.first("_left").alias("_left"))
    keys = keys.withColumn("_end", F.sum("_words").over(Window.partitionBy("_source").orderBy("_key")))
    return keys.where(
        (F.col("_end") > F.col("_left")) & (F.col("_end") - F.col("_words") <= F.col("_left"))
    ).select(
        F.col("_source").alias("_s"), F.col("_key").alias("_edge"), F.col("_words").alias("_edge_words"),
        (F.col("_left") - F.col("_end") + F.col("_words")).alias("_edge_left"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED
) -> DataFrame:
    """All rows and columns of ``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_taken`` (words taken)."""
    sized = docs.select(
        F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"),
        seeded_key(F.col("doc_id"), seed).alias("_key"),
    )
    # Three passes need the sizes; the texts are read once for them.
    sized = materialize(sized)
    targets = materialize(source_targets(sized, weights, share, cap))
    plan = targets.join(_edges(sized, targets), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = broadcast_if_small(
        materialize(plan).select(
            F.col("_source").alias("_mix_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
            "_whole", "_edge", "_edge_words", "_edge_left",
        )
    )
    rows = docs.withColumns({"_size": word_count(F.col("text")), "_key": seeded_key(F.col("doc_id"), seed)})
    part = (
        F.when(F.col("_key") < F.col("_edge"), F.col("_size"))
        .when(F.col("_key") == F.col("_edge"), F.expr("_size * _edge_left div _edge_words"))
        .otherwise(F.lit(0))
    )
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")))
        .withColumn("_taken", (F.col("_whole") * F.col("_size") + part).cast("bigint"))
        .drop("_mix_source", "_whole", "_edge", "_edge_words", "_edge_left", "_key")
    )


def report(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as it is taken; the row on the edge counts from half of its words on."""
    times = F.when(F.col("_size") > 0, F.floor((F.col("_taken") * 2 + F.col("_size")) / (F.col("_size") * 2))).otherwise(0)
    read = ("doc_id", "text", "source")
    mixed = mix(carry(docs, *read), **options).withColumn("_times", times.cast("int")).where("_times > 0")
    return mixed.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*put_back(docs.columns, *read))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size / weight AS full_at,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER
            (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT max(level) FROM levels))
         AS target
  FROM sources),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto,
         sum(size) OVER (PARTITION BY source, key) AS here
  FROM sized)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE
         WHEN upto <= floor(target) - whole * source_size THEN size
         WHEN upto - here > floor(target) - whole * source_size OR here = 0 THEN 0
         ELSE size * (CAST(floor(target) AS BIGINT) - whole * source_size - (upto - here)) // here END AS BIGINT) AS taken
FROM placed JOIN shares ON placed.source IS NOT DISTINCT FROM shares.source
"""
