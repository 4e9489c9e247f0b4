"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and runs of several consecutive sentences are hashed: from each sentence on, and up to each
sentence, the shortest run of at least ``LEAST_SENTENCES`` sentences and ``LEAST_WORDS`` words, so that the runs inside a
shared passage cover it to both ends. Equal runs are joined over all documents; the first one (smallest doc_id, then
place) stays, and every sentence that another one covers is removed. Runs are judged on the input.

A sentence of more than ``MOST_WORDS`` words counts as several. They are chosen by content, as a passage may start anywhere in it: a
word begins one if the hash of it and the next word is less than those of the ``REACH`` words before and behind. So a passage is
cut alike in every text, whatever stands before it, but for fewer words than two such sentences have at each end. Where that gives
more than ``MOST_WORDS`` words, these are counted from the last cut.

The runs are written once to the shared folder; the smallest place of each hash is pre-aggregated in the map tasks. Hashes with
more than a ``HOT_SHARE``th of all runs, so at most that many, are sent to all tasks; the others are joined by a shuffle.

Defined results: null and empty texts have no sentence and stay as they are; a null doc_id counts as the largest one; equal rows are
one document, so a run they share is first in both; rows with one doc_id and different texts are documents of their own, in the
order of a hash of the text; a very long text has runs for all its sentences; an empty table gives no rows. Extra columns, whatever
their names, pass through ``shorten_documents`` and are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .arrow import slices, strings

LEAST_SENTENCES = 2
LEAST_WORDS = 20
# A longer sentence counts as several: texts without marks have spans too.
MOST_WORDS = 25
# Words on both sides that a cut inside a long sentence is chosen among.
REACH = 3
HOT_SHARE = 2000
# A sentence with the marks and the white space behind it; the pieces make up the text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+")
_LAST = (1 << 63) - 1
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _bytes(text: str) -> bytes:
    # Splitting bytes at blanks splits at exactly the characters that part words here.
    return text.encode("utf-8", "surrogatepass")


def cuts(words: list[bytes], reach: int = REACH, most: int = MOST_WORDS) -> list[int]:
    """The words that begin a new sentence inside a long one."""
    keys = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    mixed = (keys[:-1] ^ (keys[1:] >> np.uint64(7))) * _TIMES
    mixed ^= mixed >> np.uint64(32)
    n = len(mixed)
    # Less than all others within reach; the ends of the sentence have no neighbours beyond.
    least = np.ones(n, dtype=bool)
    for k in range(1, reach + 1):
        least[:-k] &= mixed[:-k] < mixed[k:]
        least[k:] &= mixed[k:] < mixed[:-k]
    out, last = [], 0
    for at in [*np.flatnonzero(least).tolist(), len(words)]:
        out += range(last + most, at, most)
        if 0 < at < len(words):
            out.append(at)
        last = at
    return out


def sentences(text: str) -> list[str]:
    """The pieces of a text, which make it up when they are joined."""
    parts = []
    for part in SENTENCE.findall(text):
        # A word and what parts it from the next one take two characters at least.
        if len(part) > 2 * MOST_WORDS:
            data = _bytes(part)
            words = data.split()
            if len(words) > MOST_WORDS:
                raw = np.frombuffer(data, dtype=np.uint8)
                blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
                begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
                places = begins[cuts(words)].tolist()
                parts += [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *places], [*places, len(data)])]
                continue
        parts.append(part)
    return parts


def runs(parts: list[str], least: int = LEAST_SENTENCES, words: int = LEAST_WORDS):
    """(hash, first character, character behind the last) of the runs of a text."""
    if len(parts) < least:
        return []
    split = [_bytes(p).split() for p in parts]
    # Sentences without a word neither count nor separate.
    spoken = [i for i, w in enumerate(split) if w]
    n = len(spoken)
    if n < least:
        return []
    at = np.cumsum([0] + [len(p) for p in parts]).tolist()
    keys = [xxhash.xxh3_64_intdigest(b" ".join(split[i])) for i in spoken]
    upto = np.concatenate([[0], np.cumsum([len(split[i]) for i in spoken])])
    firsts = np.arange(n)
    # Behind the shortest run from each sentence; before the shortest run up to each sentence.
    stops = np.maximum(firsts + least, np.searchsorted(upto, upto[:-1] + words))
    starts = np.minimum(firsts + 1 - least, np.searchsorted(upto, upto[1:] - words, side="right") - 1)
    found = {(a, b) for a, b in zip(firsts.tolist(), stops.tolist()) if b <= n}
    found.update((a, b + 1) for a, b in zip(starts.tolist(), firsts.tolist()) if a >= 0)
    packed = np.array(keys, dtype=np.uint64).tobytes()
    return [
        (xxhash.xxh3_64_intdigest(packed[8 * a : 8 * b]) - (1 << 63), at[spoken[a]], at[spoken[b - 1] + 1])
        for a, b in sorted(found)
    ]


def _all_runs(batches):
    for part in slices(batches):
        hashes, ids, marks, firsts, stops = [], [], [], [], []
        columns = part.column("owner").to_pylist(), part.column("mark").to_pylist(), strings(part.column("text"))
        for owner, mark, text in zip(*columns):
            for key, first, stop in runs(sentences(text)):
                hashes.append(key)
                ids.append(owner)
                marks.append(mark)
                firsts.append(first)
                stops.append(stop)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int64()) for x in (hashes, ids, marks)], *[pa.array(x, pa.int32()) for x in (firsts, stops)]],
            names=["run", "owner", "mark", "first", "stop"],
        )


def _cut(text: str, firsts, stops) -> tuple[int, int, str]:
    """(sentences, sentences removed, what remains) of a text without the sentences of its spans."""
    parts = sentences(text)
    ends = np.cumsum([len(p) for p in parts])
    lost = np.zeros(len(parts), dtype=bool)
    for first, stop in zip(firsts, stops):
        lost[np.searchsorted(ends, first, side="right") : np.searchsorted(ends, stop, side="left") + 1] = True
    return len(parts), int(lost.sum()), text if not lost.any() else "".join([p for p, gone in zip(parts, lost) if not gone])


def _without(batches):
    for part in slices(batches):
        texts, counts, removed = [], [], []
        for text, firsts, stops in zip(
            part.column("text").to_pylist(), part.column("firsts").to_pylist(), part.column("stops").to_pylist()
        ):
            count, lost, rest = _cut(text or "", firsts or (), stops or ())
            counts.append(count)
            removed.append(lost)
            texts.append(rest if lost else text)
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
            names=["row", "text", "n_sentences", "n_removed"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(row, text, n_sentences, n_removed): each row of ``docs`` without its text, what remains of the text, and the counts."""
    spark = docs.sparkSession
    where = scratch_path(spark, "sentence-runs")
    owner, mark = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), F.xxhash64("text")
    docs.select(owner.alias("owner"), mark.alias("mark"), "text").mapInArrow(
        _all_runs, "run bigint, owner bigint, mark bigint, first int, stop int"
    ).write.parquet(where)
    found = spark.read.parquet(where)
    # A document may hold a run twice, so its place says which occurrence is first.
    place = F.struct("owner", "mark", "first")
    firsts_at = scratch_path(spark, "sentence-firsts")
    found.groupBy("run").agg(F.min(place).alias("_least"), F.count("*").alias("_n")).where("_n > 1").write.parquet(firsts_at)
    firsts = spark.read.parquet(firsts_at)
    hot = F.col("_n") > found.count() // HOT_SHARE
    # At most HOT_SHARE rows.
    frequent = F.broadcast(firsts.where(hot))
    repeated = found.join(frequent, "run").unionByName(
        found.join(F.broadcast(firsts.where(hot).select("run")), "run", "left_anti").join(firsts.where(~hot), "run")
    ).where(place != F.col("_least"))
    # One row per document; a document has at most two runs for each of its sentences.
    spans = repeated.groupBy("owner", "mark").agg(
        F.sort_array(F.collect_set(F.struct("first", "stop"))).alias("spans")
    )
    # All other columns in one, so that none can clash.
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(owner.alias("owner"), mark.alias("mark"), "text", F.struct(*rest).alias("row"))
    joined = rows.join(spans, ["owner", "mark"], "left").select(
        "row", "text", F.col("spans.first").alias("firsts"), F.col("spans.stop").alias("stops")
    )
    counts = [T.StructField(name, T.LongType()) for name in ("n_sentences", "n_removed")]
    return joined.mapInArrow(_without, T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), *counts]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed and the remaining text."""
    return remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", "n_sentences", "n_removed", "text")


def shorten_documents(docs: DataFrame) -> DataFrame:
    """The documents without repeated spans; ``n_chars`` follows the text. Every document stays, an emptied one too."""
    rest = remove_repeats(docs)
    own = {c: F.col("row").getField(c) for c in docs.columns if c != "text"}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(own["n_chars"])
    return rest.select(*[(F.col("text") if c == "text" else own[c]).cast(t).alias(c) for c, t in docs.dtypes])
