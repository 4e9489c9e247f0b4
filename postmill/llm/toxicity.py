"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (2 to 5 characters, lower case, present or absent) hashed to ``BINS`` bins. Each bin
is scaled by the log of its smoothed share in toxic texts over its share in other texts; on the scaled features a
logistic regression is trained, and its weights are interpolated with their mean size. Training takes a bounded sample
of the labelled rows that have a text: ``TRAIN_ROWS`` rows of each class in the order of a hash, as far as ``TRAIN_FEATURES``
features go. Features are found in tasks, so a text of any length can be in the sample. Scoring is one pass over whole texts and
needs no shuffle.

Defined results: an empty or null text has no feature, its score comes from the intercept. If the sample is empty or holds
one class only, every score is 0, or 1 if that class is the toxic one. An id with both labels is toxic. Each row gives one row;
repeated rows and null ids are scored like any other, a null id is never held out; a very long text is scored whole; an empty
table gives no rows. Extra columns, whatever their names, pass through ``drop_toxic`` and are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .arrow import forget_caches, slices, strings
from .carry import carry, put_back

BITS = 20
BINS = 1 << BITS
ORDERS = (2, 3, 4, 5)
# Bounds of the sample that the classifier is fitted on: rows of each class, and features in all.
TRAIN_ROWS = 1500
TRAIN_FEATURES = 20_000_000
LEAST_TEXTS = 3
FOLDS = 5

# Fixed odd multipliers of the hash.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def bins_of(text: str) -> np.ndarray:
    """The distinct bins of a text's n-grams."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    parts = []
    for order in ORDERS:
        if len(codes) < order:
            break
        n = len(codes) - order + 1
        h = np.full(n, order, dtype=np.uint64)
        for k in range(order):
            h = (h ^ codes[k : k + n]) * np.uint64(_MIX[k])
            h ^= h >> np.uint64(29)
        parts.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


class Distinct:
    """Distinct values of small integers by one scatter; the scratch array is kept."""

    def __init__(self):
        self.seen = np.zeros(BINS, dtype=np.int32)

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        places = np.arange(len(bins), dtype=np.int32)
        self.seen[bins] = places
        return bins[self.seen[bins] == places]


def fit(texts: list[str], toxic: np.ndarray, **options):
    """(weights of the bins, intercept) of the classifier."""
    distinct = Distinct()
    return fit_bins([distinct(bins_of(t)) for t in texts], toxic, **options)


def fit_bins(rows: list[np.ndarray], toxic: np.ndarray, steps: int = 60, ridge: float = 1e-3, blend: float = 0.9):
    """``fit`` on the distinct bins of each text."""
    if len(rows) == 0 or toxic.all() or not toxic.any():
        return np.zeros(BINS, dtype=np.float32), (50.0 if len(rows) and toxic.all() else -50.0)
    seen = np.zeros(BINS, dtype=np.int32)
    for row in rows:
        seen[row] += 1
    used = seen >= min(LEAST_TEXTS, max(1, len(rows) // 50))
    column, width = (np.cumsum(used) - 1).astype(np.int32), int(used.sum())
    # A constant column keeps rows and columns without an entry out of the sums below.
    sizes = np.array([int(used[row].sum()) + 1 for row in rows], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cols = np.full(int(ends[-1]), width, dtype=np.int32)
    for i, start in enumerate(starts.tolist()):
        # Each row is let go when it is in the matrix.
        row, rows[i] = rows[i], None
        cols[start : start + sizes[i] - 1] = column[row[used[row]]]
        del row
    # The owners of each column's entries: (column, owner) pairs sorted in place.
    many = max(1, (len(sizes) - 1).bit_length())
    pairs = cols.astype(np.uint32 if width.bit_length() + many <= 32 else np.uint64)
    pairs <<= many
    for i, start in enumerate(starts.tolist()):
        pairs[start : start + sizes[i]] |= pairs.dtype.type(i)
    pairs.sort()
    firsts = np.append(0, np.cumsum(seen[used], dtype=np.int64))
    pairs &= pairs.dtype.type((1 << many) - 1)
    owner = pairs.astype(np.uint16 if many <= 16 else np.int32)
    del pairs

    def by_text(values):
        """Sum over each text's columns."""
        return np.add.reduceat(np.append(values, 0).astype(np.float32)[cols], starts).astype(np.float64)

    def by_column(values):
        """Sum over the texts that have each column."""
        return np.add.reduceat(values.astype(np.float32)[owner], firsts)[:width].astype(np.float64)

    p, q = 1 + by_column(toxic * 1.0), 1 + by_column(~toxic * 1.0)
    ratio = np.log((p / (1 + toxic.sum())) / (q / (1 + (~toxic).sum())))
    y = np.where(toxic, 1.0, 0.0)
    # Each class has half of the weight of the loss.
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, b, speed, speed_b = np.zeros(width), 0.0, np.zeros(width), 0.0
    rate = 4.0 / max(by_text(ratio * ratio).mean(), 1e-9)
    for _ in range(steps):
        ahead, ahead_b = w + 0.9 * speed, b + 0.9 * speed_b
        z = by_text(ratio * ahead) + ahead_b
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = ratio * by_column(miss) + ridge * ahead
        speed, speed_b = 0.9 * speed - rate * grad, 0.9 * speed_b - rate * miss.sum()
        w, b = w + speed, b + speed_b
    w = (1 - blend) * np.abs(w).mean() + blend * w
    z = by_text(ratio * w)
    # The intercept is set for the blended weights: between the classes, at the least weighted loss.
    best = min(
        np.linspace(np.quantile(z, 0.01), np.quantile(z, 0.99), 201),
        key=lambda c: float((weight * np.logaddexp(0, np.where(toxic, c - z, z - c))).sum()),
    )
    weights = np.zeros(BINS, dtype=np.float32)
    weights[used] = w * ratio
    return weights, -float(best)


def _features(batches):
    distinct = Distinct()
    for part in slices(batches):
        bins = [distinct(bins_of(t)) for t in strings(part.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("toxic"), pa.array([len(b) for b in bins], pa.int32()),
             pa.array([b.tobytes() for b in bins], pa.binary())],
            names=["doc_id", "toxic", "n", "bins"],
        )


def _fitted(batches):
    """One row with the weights and the intercept for the rows of the sample, if there are any."""
    forget_caches()
    rows, toxic = [], []
    for batch in batches:
        rows += [np.frombuffer(b.as_buffer(), dtype=np.int32) for b in batch.column("bins")]
        toxic += batch.column("toxic").to_pylist()
    if rows:
        weights, intercept = fit_bins(rows, np.array(toxic, dtype=bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([intercept], pa.float64())], names=["weights", "intercept"])


def train(docs: DataFrame, labels: DataFrame):
    """Fit on the bounded sample; only rows outside the held-out fold are read."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic") > 0).alias("toxic"))
    # Classes are filled up with labels that have a text.
    there = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    usable = known.join(there, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.where("toxic").orderBy(*order).limit(TRAIN_ROWS).unionByName(
        usable.where("NOT toxic").orderBy(*order).limit(TRAIN_ROWS)
    )
    where = scratch_path(spark, "toxicity-sample")
    # At most 2 x TRAIN_ROWS ids are broadcast.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    found = texts.select("doc_id", "toxic", "text").mapInArrow(_features, "doc_id bigint, toxic boolean, n int, bins binary")
    # The digest settles the order of rows with one id.
    found.withColumn("digest", F.xxhash64("bins")).write.parquet(where)
    stored = spark.read.parquet(where)
    order += [F.col("n"), F.col("digest")]
    parts = []
    for kind in (True, False):
        rows = stored.where(F.col("toxic") == kind)
        head = rows.select("doc_id", "n", "digest").orderBy(*order).limit(TRAIN_ROWS).collect()
        # One text at least, which has BINS features at most.
        fitting = max(1, int(np.searchsorted(np.cumsum([r["n"] for r in head]), TRAIN_FEATURES // 2, side="right")))
        parts.append(rows.orderBy(*order).limit(fitting))
    # The bounded sample meets in one task, which fits on it; the driver gets the weights alone.
    fitted = parts[0].unionByName(parts[1]).repartition(1).sortWithinPartitions(F.col("toxic").desc(), *order)
    model = fitted.select("toxic", "bins").mapInArrow(_fitted, "weights binary, intercept double").collect()
    if not model:
        return fit_bins([], np.zeros(0, dtype=bool))
    return np.frombuffer(model[0]["weights"], dtype=np.float32), model[0]["intercept"]


def _scored(docs: DataFrame, model) -> DataFrame:
    """(text, row, p): ``docs`` as ``carry`` has them, with the toxicity score of the whole text."""
    context = docs.sparkSession.sparkContext
    weights, intercept = model
    sent = context.broadcast(weights)  # BINS floats, whatever the size of the data
    def run(batches):
        forget_caches()
        distinct = Distinct()
        table = sent.value
        for part in slices(batches):
            z = np.array([table[distinct(bins_of(t))].sum(dtype=np.float64) for t in strings(part.column("text"))])
            p = 1 / (1 + np.exp(-np.clip(z + intercept, -50, 50)))
            yield part.append_column("p", pa.array(p, type=pa.float64()))

    carried = carry(docs, "text")
    return carried.mapInArrow(run, T.StructType([*carried.schema.fields, T.StructField("p", T.DoubleType())]))


def score(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the toxicity score of the whole text."""
    return _scored(docs, model).select(*put_back(docs.columns, "text"), F.col("p").alias(column))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below ``threshold``."""
    kept = _scored(docs, train(docs, labels)).where(F.col("p") < threshold)
    return kept.select(*put_back(docs.columns, "text"))
