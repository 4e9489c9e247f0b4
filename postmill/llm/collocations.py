"""Phrases of two to four words that occur together more often than their parts: counts by multikey quicksort of suffixes.

Words of all texts are counted first (pre-aggregated per block), per language. A suffix is a place in a piece of text, read up
to ``DEPTH`` words or to the first word that is too rare for any candidate; rare words are known by a bit table of fixed size
that holds the frequent ones, so a wrong bit only keeps more. Equal suffixes of a block become one with its count.

Suffixes are routed by their leading words: by the first, or, while the words so far are hot (more occurrences than
``PART_WORDS``), by as many as it takes to reach one that is not. So no group of a route has more than ``PART_WORDS``
suffixes, however often a word or a passage occurs. A task sorts its suffix pointers by multikey three-way quicksort down to
``DEPTH`` words; the size of an equal partition is the count of its phrase, and a partition below ``LEAST`` is abandoned. Only
a phrase made of hot words alone can be spread over routes: such a partition is counted in every task and summed up at the end.

Scores, cuts and containment are joins and groupings of the phrases. Products are decimals, so nothing overflows.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows and null ids count like any
other row; pieces without words and phrases across pieces do not exist; a very long text is one text like any other, so
nothing is cut off; equal scores are ordered by count, then by phrase; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrow import slices
from .scan import BLANK, BREAK, Words

DEPTH = 4
LEAST = 30
TOP = 2000
COVER_PERCENT = 80
SCORE_UNIT = 2_000_000
NO_LANGUAGE = "und"
BLOCK_BYTES = 8 << 20
# Suffixes of a task; a word with more occurrences is hot.
PART_WORDS = 1 << 20
# Hot words are at most this share of all words each, so their list is bounded.
MOST_HOT = 1 << 20
TABLE_BITS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    classes = np.zeros(256, dtype=np.uint8)
    classes[[0x20, 0x09]] = BLANK
    classes[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
    return classes


def _by_language(batches):
    """(language, words) of blocks of texts."""
    classes = _classes()
    for part in slices(batches, max_bytes=BLOCK_BYTES):
        named = pc.fill_null(part.column("lang"), NO_LANGUAGE).dictionary_encode()
        for code, name in enumerate(named.dictionary.to_pylist()):
            yield name, Words(part.column("text").filter(pc.equal(named.indices, code)), classes)


def _marks(language: str, words) -> np.ndarray:
    """A 64-bit mark of each word of a language."""
    texts = [f"{language}\t{w.decode()}" for w in words.to_pylist()]
    return pd.util.hash_array(np.array(texts, dtype=object)) if texts else np.zeros(0, dtype=np.uint64)


def _count(batches):
    for language, words in _by_language(batches):
        counts = np.bincount(words.codes, minlength=len(words.distinct))
        n = len(counts)
        # The row without a word holds the total of the block.
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([language] * (n + 1), pa.string()),
            "phrase": pa.concat_arrays([words.distinct.cast(pa.binary()).cast(pa.string()), pa.array([None], pa.string())]),
            "mark": pa.array(np.append(_marks(language, words.distinct), np.uint64(0)).view(np.int64)),
            "n": pa.array(np.append(counts, counts.sum())),
        })


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, mark, n): words with at least ``least`` occurrences, and one row with a null phrase for all words."""
    counted = docs.select("lang", "text").mapInArrow(_count, "lang string, phrase string, mark bigint, n bigint")
    return counted.groupBy("lang", "phrase", "mark").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= least) | F.col("phrase").isNull()
    )


def _frequent_bits(words: DataFrame) -> np.ndarray:
    """One bit per slot of marks, set where a frequent word has it; at most 2 ** (TABLE_BITS - 6) rows are collected."""
    slot = F.col("mark").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    rows = (
        words.where("phrase IS NOT NULL")
        .select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(mark & 63 AS int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    ).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def _has(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    slot = marks & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers by byte: all lowest bytes first, which compresses well."""
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T).reshape(-1).view(kind).astype(np.int64)


def pack_windows(windows: np.ndarray, times: np.ndarray, words: int) -> bytes:
    """Sorted windows ([depth, window], -1 for none) with their counts, compressed."""
    wide = "<u4" if words > 0xFFFE else "<u2"
    first = np.diff(windows[0], prepend=0)
    parts = [_planes(first, wide), *[_planes(w + 1, wide) for w in windows[1:]], _planes(times, "<u4")]
    return pa.compress(b"".join(parts), codec=CODEC, asbytes=True)


def unpack_windows(data: bytes, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    size = 4 if words > 0xFFFE else 2
    raw = pa.decompress(data, n * (size * DEPTH + 4), codec=CODEC, asbytes=True)
    step = n * size
    columns = [_from_planes(raw[k * step : (k + 1) * step], n, f"<u{size}") for k in range(DEPTH)]
    return np.stack([np.cumsum(columns[0]), *[c - 1 for c in columns[1:]]]), _from_planes(raw[DEPTH * step :], n, "<u4")


CODEC = "zstd"
ROUTED = "part int, lang string, n_words int, word_bytes int, n int, words binary, windows binary"


def _router(table: np.ndarray, hot_marks: np.ndarray, parts: int):
    def run(batches):
        for language, words in _by_language(batches):
            codes, piece = words.codes, words.piece
            marks = _marks(language, words.distinct)
            known = _has(table, marks)[codes]
            # Whether a word and the next one can be in one phrase.
            linked = known[:-1] & known[1:] & (piece[:-1] == piece[1:]) if len(codes) else np.zeros(0, dtype=bool)
            linked = np.append(linked, np.zeros(DEPTH, dtype=bool))
            at = np.flatnonzero(linked)
            if len(at) == 0:
                continue
            windows = np.full((DEPTH, len(at)), -1, dtype=np.int32)
            alive = np.ones(len(at), dtype=bool)
            for k in range(DEPTH):
                windows[k, alive] = codes[at[alive] + k]
                alive = alive & linked[at + k]
            # Equal suffixes of the block become one.
            base = len(marks) + 1
            high, low = ((windows[k].astype(np.int64) + 1) * base + windows[k + 1] + 1 for k in (0, 2))
            order = np.lexsort((low, high))
            new = np.append(True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0))
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            windows = windows[:, order[new]]
            hot = np.isin(marks, hot_marks)
            route, going = marks[windows[0]].copy(), hot[windows[0]]
            for k in range(1, DEPTH):
                going = going & (windows[k] >= 0)
                route[going] = route[going] * _MIX + marks[windows[k, going]]
                going[going] = hot[windows[k, going]]
            part = ((route ^ (route >> np.uint64(29))) * _MIX >> np.uint64(17)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, windows, times = part[order].astype(np.int64), windows[:, order], times[order]
            firsts = np.flatnonzero(np.append(True, np.diff(part) != 0))
            counts = np.diff(np.append(firsts, len(part)))
            row = np.repeat(np.arange(len(firsts)), counts)
            # Each row carries its distinct words; a window holds places among them. The empty place comes first, if there is one.
            named, places = np.unique(row * base + windows + 1, return_inverse=True)
            places = places.reshape(DEPTH, -1)
            row_of, word = named // base, named % base - 1
            begin = np.searchsorted(row_of, np.arange(len(firsts) + 1))
            empty = np.bincount(row_of[word < 0], minlength=len(firsts))
            local = places - (begin[:-1] + empty)[row]
            spelled = words.distinct.take(pa.array(np.maximum(word, 0))).to_pylist()
            out = []
            for r, (first, n) in enumerate(zip(firsts.tolist(), counts.tolist())):
                mine = spelled[begin[r] + empty[r] : begin[r + 1]]
                text = b" ".join([*mine, b""])
                packed = pack_windows(local[:, first : first + n], times[first : first + n], len(mine))
                out.append((int(part[first]), language, len(mine), len(text), n, pa.compress(text, codec=CODEC, asbytes=True), packed))
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in ROUTED.split(", ")]
            )

    return run


def frequent_prefixes(windows: np.ndarray, times: np.ndarray, hot: np.ndarray, least: int):
    """[(a window, number of words, count)] of the phrases that at least ``least`` windows begin with.

    ``windows`` is [depth, window], -1 behind the last word. Phrases of hot words alone have windows in other tasks too, so
    they come with any count, but for those of full depth.
    """
    found = []
    depths = len(windows)
    order = np.arange(windows.shape[1])
    todo = [(0, len(order), 0, True)]
    while todo:
        lo, hi, depth, spread = todo.pop()
        rows = order[lo:hi].copy()
        keys = windows[depth][rows]
        pivot = sorted((int(keys[0]), int(keys[len(keys) // 2]), int(keys[-1])))[1]
        below, above = keys < pivot, keys > pivot
        same = rows[~(below | above)]
        at = lo
        for side in (below, above):
            side_rows = rows[side]
            if len(side_rows) and (times[side_rows].sum() >= least or (spread and hot[keys[side]].any())):
                order[at : at + len(side_rows)] = side_rows
                todo.append((at, at + len(side_rows), depth, spread))
                at += len(side_rows)
        if pivot < 0:
            continue
        count = int(times[same].sum())
        open_here = spread and bool(hot[pivot]) and depth + 1 < depths
        if count < least and not open_here:
            continue
        if depth:
            found.append((int(same[0]), depth + 1, count))
        if depth + 1 < depths:
            order[at : at + len(same)] = same
            todo.append((at, at + len(same), depth + 1, open_here))
    return found


def _miner(hot_marks: np.ndarray, least: int):
    def run(batches):
        held = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["lang"], []).append(row)
        for language in sorted(held):
            texts, windows, times, before = [], [], [], 0
            for row in held.pop(language):
                texts.append(pa.decompress(row["words"], row["word_bytes"], codec=CODEC, asbytes=True))
                found, many = unpack_windows(row["windows"], row["n"], row["n_words"])
                windows.append(np.where(found < 0, -1, found + before).astype(np.int32))
                times.append(many)
                before += row["n_words"]
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            blank = np.flatnonzero(data == 0x20)
            # A blank behind each word.
            ends = np.append(0, blank - np.arange(len(blank)))
            words = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(blank), [None, pa.py_buffer(ends), pa.py_buffer(data[data != 0x20])]
            ).dictionary_encode()
            codes, distinct = words.indices.to_numpy(zero_copy_only=False), words.dictionary
            windows, times = np.concatenate(windows, axis=1), np.concatenate(times)
            windows = np.where(windows < 0, np.int32(-1), codes[np.maximum(windows, 0)])
            hot = np.isin(_marks(language, distinct), hot_marks)
            found = frequent_prefixes(windows, times, hot, least)
            for size in range(2, DEPTH + 1):
                mine = [(row, n) for row, k, n in found if k == size]
                if mine:
                    at = np.array([row for row, _ in mine])
                    parts = [distinct.take(pa.array(windows[k][at])).cast(pa.binary()).cast(pa.string()) for k in range(size)]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([language] * len(mine), pa.string()),
                        "phrase": pc.binary_join_element_wise(*parts, " "),
                        "n": pa.array([n for _, n in mine], pa.int64()),
                    })

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n): phrases of 2 to ``DEPTH`` words with at least ``least`` occurrences; ``words`` as stored word_counts."""
    sums = words.agg(
        F.sum(F.when(F.col("phrase").isNull(), F.col("n"))).alias("every"),
        F.sum(F.when(F.col("phrase").isNotNull(), F.col("n"))).alias("frequent"),
    ).first()
    hot_from = max(PART_WORDS, (sums["every"] or 0) // MOST_HOT)
    hot = words.where(F.col("phrase").isNotNull() & (F.col("n") > hot_from)).select("mark").toPandas()
    hot_marks = hot["mark"].to_numpy(dtype=np.int64).view(np.uint64)
    parts = max(1, -(-(sums["frequent"] or 0) // PART_WORDS))
    routed = docs.select("lang", "text").mapInArrow(
        _router(_frequent_bits(words), hot_marks, parts), ROUTED
    )
    mined = routed.repartitionById(parts, F.col("part")).mapInArrow(
        _miner(hot_marks, least), "lang string, phrase string, n bigint"
    )
    return mined.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    spark = docs.sparkSession
    word_path, phrase_path = scratch_path(spark, "phrase-words"), scratch_path(spark, "phrases")
    word_counts(docs, least).write.parquet(word_path)
    words = spark.read.parquet(word_path)
    phrase_counts(docs, words, least).write.parquet(phrase_path)
    phrases = spark.read.parquet(phrase_path).withColumnRenamed("n", "a").withColumn("parts", F.split("phrase", " "))
    singles = words.where("phrase IS NOT NULL").select("lang", "phrase", "n")
    counts = singles.unionByName(phrases.select("lang", "phrase", F.col("a").alias("n")))

    cuts = phrases.select(
        "lang", "phrase", "a", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut",
        F.concat_ws(" ", F.slice("parts", F.lit(1), F.col("cut"))).alias("first"),
        F.concat_ws(" ", F.slice("parts", F.col("cut") + 1, F.size("parts") - F.col("cut"))).alias("rest"),
    )
    # A part of a frequent phrase is frequent, so it has its count here.
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn(
        "score", F.expr(f"(cast(a AS decimal(20,0)) * {SCORE_UNIT}) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    )
    lowest = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low")
    ).select("lang", "phrase", "a", "low.l", "low.r", "low.score")

    size = F.size("parts")
    inner = [(n, i) for n in range(2, DEPTH) for i in range(DEPTH - n + 1)]
    held = phrases.where(size > 2).select(
        "lang", "a",
        F.explode(F.array_compact(F.array(*[
            F.when((size > n) & (size >= n + i), F.concat_ws(" ", F.slice("parts", i + 1, n))) for n, i in inner
        ]))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where(
        F.col("longest").isNull()
        | (F.col("longest").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVER_PERCENT)
    )
    totals = words.where("phrase IS NULL").select("lang", "n")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").cast("binary"))
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), spoken AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spoken
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a
  FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
        FROM (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM places) WHERE i + k - 1 <= len(w))
  GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND a >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS first,
         array_to_string(list_slice(w, cut + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), cuts AS (
  SELECT p.lang, p.phrase, p.a, x.a AS l, y.a AS r, cut, (p.a::HUGEINT * 2000000) // (x.a::HUGEINT + y.a::HUGEINT) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.first JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longest IS NULL OR 100 * i.longest::HUGEINT < 80 * s.a::HUGEINT
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
         phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
