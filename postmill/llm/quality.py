"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio between trusted texts and the corpus.

Tokens are runs of letters and numbers and runs of other visible characters. Unigrams and bigrams of all texts are hashed
to ``BINS`` bins each; two multinomials over the bins are counted, one over the trusted target (all
documents labelled as good) and one over the raw corpus (all documents). A text's score is the mean log ratio of its
n-grams, and a text is kept if the score is at least ``LEAST_RATIO``. Ratios are whole millionths, so sums do not depend
on an order and every run decides alike.

Only DataFrame functions. The counts per bin are pre-aggregated in each task; the ratios (2 x ``BINS`` numbers at most) go to all
tasks as two constant arrays; the n-grams of a text stay in its own row, and the verdict needs no shuffle.

Defined results: a null text has no words and fails the base rules; repeated rows and null ids are judged like any other
row; without labelled good documents all ratios are 0 and only the base rules decide; a very long text is judged whole, its
n-grams stay in its task; an empty table gives no rows. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
BINS = 1 << 15
SMOOTHING = 1.0
# Mean log ratio from which on a text is kept.
LEAST_RATIO = -0.25
UNIT = 1_000_000


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column ``text``."""
    body = F.coalesce(F.col(text), F.lit(""))
    blank = F.lit("")
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumns({
        "_words": F.array_remove(F.split(body, BLANKS), blank),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("bigint"),
        "_lines": lines,
    })
    step = step.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_lines", "_words")
    # A window is two pairs of words and the word behind them.
    step = step.withColumn("_pairs", F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1))))
    windows = F.transform(
        F.slice("_pairs", 1, F.greatest(F.size("_pairs") - (WINDOW - 1), F.lit(0))),
        lambda p, i: F.xxhash64(p, F.get("_pairs", i + 2), F.get("_hashes", i + 4)),
    )
    step = step.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows)).drop("_hashes", "_pairs")
    # Only texts that repeat a window sort theirs: (hash, place), so equal windows are neighbours.
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_sorted", F.when(repeats, pairs)).drop("_windows")
    twice = F.filter(
        "_sorted",
        lambda e, i: F.coalesce(F.get("_sorted", i - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("_sorted", i + 1)["h"] == e["h"], F.lit(False)),
    )
    step = step.withColumn("_twice", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("_sorted")
    gaps = F.transform("_twice", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_twice")


def _token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _gram_bins(hashes: str) -> Column:
    """The bins of a text's unigrams and bigrams."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(BINS)).cast("int"))
    twos = F.transform(
        hashes,
        lambda h, i: (F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BINS)) + BINS).cast("int"),
    )
    # The last token starts no bigram.
    return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality > 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def gram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_bin, _raw, _target): how often each bin occurs in all texts and in the trusted ones, stored once."""
    spark = docs.sparkSession
    trusted = trusted_ids(labels).select(F.col("doc_id").cast("bigint").alias("_trusted"))
    # Rows without an id are dealt out by their text; no label meets them.
    known = F.col("doc_id").isNotNull()
    texts = docs.select(
        known.alias("_known"), F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("_id"), "text"
    )
    # The labels grow with the corpus, so both sides are shuffled at any size, and each text once.
    marked = texts.join(trusted.hint("merge"), F.col("_known") & (F.col("_id") == F.col("_trusted")), "left")
    grams = marked.select(F.col("_trusted").isNotNull().alias("_good"), _token_hashes(F.col("text")).alias("_hashes")).select(
        "_good", F.explode(_gram_bins("_hashes")).alias("_bin")
    )
    where = scratch_path(spark, "gram-counts")
    grams.groupBy("_bin").agg(F.count("*").alias("_raw"), F.count_if("_good").alias("_target")).write.parquet(where)
    return spark.read.parquet(where)


def gram_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_bin, _units): log of trusted share over corpus share of each bin, in millionths."""
    counts = gram_counts(docs, labels)
    total = counts.agg(F.sum("_raw").alias("r"), F.sum("_target").alias("t")).first()
    raw, target = float(total["r"] or 0), float(total["t"] or 0)
    if not target:
        return counts.select("_bin", F.lit(0).cast("bigint").alias("_units"))
    added = SMOOTHING * 2 * BINS
    ratio = F.log((F.col("_target") + SMOOTHING) / (target + added)) - F.log((F.col("_raw") + SMOOTHING) / (raw + added))
    return counts.select("_bin", F.round(ratio * UNIT).cast("bigint").alias("_units"))


def _units(hashes: str, ratios: DataFrame) -> Column:
    """The summed ratios of a text's unigrams and bigrams; ``ratios`` (_bin, _units) has ``2 * BINS`` rows at most."""
    units = [0] * (2 * BINS)
    for row in ratios.collect():
        units[row["_bin"]] = row["_units"]
    ones, twos = [F.split(F.lit(",".join(map(str, part))), ",").cast("array<bigint>") for part in (units[:BINS], units[BINS:])]
    # BINS is a power of two.
    place = lambda h: h.bitwiseAND(F.lit(BINS - 1).cast("bigint")).cast("int")
    each = F.transform(
        hashes, lambda h, i: F.get(ones, place(h)) + F.get(twos, place(F.xxhash64(h, F.get(hashes, i + 1))))
    )
    # The last token starts no bigram, so what it added goes off again.
    last = F.get(twos, place(F.xxhash64(F.get(hashes, F.size(hashes) - 1))))
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda total, x: total + x) - last
    return F.when(F.size(hashes) > 0, total)


def judge(docs: DataFrame, labels: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, n_grams, ratio and kept."""
    ratios = gram_ratios(docs, labels)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = base_counts(docs.select("doc_id", "text")).withColumn("_hashes", _token_hashes(F.col("text"))).drop("text")
    judged = counted.select(
        *names, F.greatest(2 * F.size("_hashes") - 1, F.lit(0)).cast("bigint").alias("n_grams"), _units("_hashes", ratios).alias("_units")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    good = F.coalesce(F.col("_units") >= F.col("n_grams") * int(least_ratio * UNIT), F.lit(False))
    return judged.withColumn("base_failed", failed).select(
        *names, "base_failed", (~failed & good).alias("kept"), "n_grams",
        (F.col("_units") / F.nullif("n_grams", F.lit(0)) / UNIT).alias("ratio"),
    )
