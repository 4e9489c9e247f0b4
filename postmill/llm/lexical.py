"""Ranked lexical search over block-compressed postings with Block-Max MaxScore.

Each task indexes its documents in shards: a document is a number in its shard, a term's list is cut into blocks of ``BLOCK``
postings that are stored as narrow differences to the block's first document, and each block keeps its last document, its most
frequent occurrence and its shortest document. These bound every score in the block, since a score grows with tf and falls with
the document's length. An index is a Parquet table, one row per shard, and is read for any queries.

Queries are searched in blocks of a bounded size. Statistics of their terms are summed over the shards first. Then each shard
is searched for each query: global bounds of the terms, in ascending order, are summed up; lists whose sum stays below the k-th
score found so far are not essential. Documents of essential lists are the candidates; a non-essential list, highest first,
rejects a candidate whose score and the bounds left cannot reach the k-th score, first by the term's bound, then by the block
the candidate would be in, and only blocks with candidates left are unpacked. A task carries each query's best
documents from shard to shard; the heaps of all tasks are merged at the end.

Defined results: a null or empty text has no terms and is not counted; rows with one id are documents of their own, and of equal
scores and ids each has a rank; a null doc_id comes last among equal scores; rows with one item_id are one item; an item without
terms, or without a document, has no rows; a very long text is one document, whatever its size; empty tables give no rows.
Other columns of both tables are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrow import slices
from .scan import BLANK, Words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
SHARD_BYTES = 16 << 20
# Documents of a shard: a place in a block fits 16 bits.
SHARD_DOCS = 1 << 16
BLOCK = 128
# Distinct (item, term) rows of a block of queries.
QUERY_ROWS = 100_000
UNIT = 1_000_000_000
_NO_ID = np.int64((1 << 63) - 1)


def _classes() -> np.ndarray:
    classes = np.full(256, BLANK, dtype=np.uint8)
    classes[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 0
    classes[0x80:] = 0
    return classes


def _within(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers firsts[i], firsts[i] + 1, ... of each i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - counts), counts)


def index_shard(doc_ids, texts) -> dict[str, bytes]:
    """The columns of a shard, each as bytes."""
    words = Words(texts, _classes())
    docs = len(texts)
    lengths = np.bincount(words.owner, minlength=docs).astype(np.int32)
    keys = np.sort(words.codes.astype(np.int64) * docs + words.owner)
    at = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.append(at, len(keys)))
    doc, term = keys[at] % max(docs, 1), keys[at] // max(docs, 1)
    df = np.bincount(term, minlength=len(words.distinct))
    blocks = -(-df // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK)
    sizes[np.cumsum(blocks) - 1] = df - (blocks - 1) * BLOCK
    begin = np.cumsum(sizes) - sizes
    offset = doc - np.repeat(doc[begin], sizes)
    # A list whose places and counts fit one byte goes to the narrow streams.
    first = np.cumsum(df) - df
    wide = np.zeros(len(df), dtype=bool)
    if len(df):
        wide = (np.maximum.reduceat(offset, first) > 255) | (np.maximum.reduceat(tf, first) > 255)
    far = np.repeat(wide, df)
    nulls = pc.is_null(doc_ids).to_numpy(zero_copy_only=False)
    known = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    spelled = words.distinct
    return {
        "doc_ids": known.tobytes(), "nulls": nulls.astype(np.uint8).tobytes(), "lengths": lengths.tobytes(),
        "terms": b"".join(spelled.to_pylist()), "term_sizes": pc.binary_length(spelled).to_numpy().astype("<i4").tobytes(),
        "df": df.astype("<i4").tobytes(), "wide": wide.astype(np.uint8).tobytes(),
        "block_first": doc[begin].astype("<u2").tobytes(), "block_last": doc[begin + sizes - 1].astype("<u2").tobytes(),
        "block_tf": (np.maximum.reduceat(tf, begin) if len(tf) else tf).astype("<i4").tobytes(),
        "block_length": (np.minimum.reduceat(lengths[doc], begin) if len(doc) else doc).astype("<i4").tobytes(),
        "narrow_docs": offset[~far].astype(np.uint8).tobytes(), "narrow_tf": tf[~far].astype(np.uint8).tobytes(),
        "wide_docs": offset[far].astype("<u2").tobytes(), "wide_tf": tf[far].astype("<i4").tobytes(),
    }


BLOBS = (
    "doc_ids", "nulls", "lengths", "terms", "term_sizes", "df", "wide", "block_first", "block_last", "block_tf", "block_length",
    "narrow_docs", "narrow_tf", "wide_docs", "wide_tf",
)
STATISTICS = ("terms", "term_sizes", "df", "block_tf", "block_length")


def _indexer(batches):
    for part in slices(batches, max_bytes=SHARD_BYTES):
        for start in range(0, part.num_rows, SHARD_DOCS):
            rows = part.slice(start, SHARD_DOCS)
            shard = index_shard(rows.column("doc_id"), rows.column("text"))
            lengths = np.frombuffer(shard["lengths"], dtype="<i4")
            yield pa.RecordBatch.from_pydict({
                "docs": pa.array([int((lengths > 0).sum())], pa.int64()),
                "words": pa.array([int(lengths.sum(dtype=np.int64))], pa.int64()),
                **{name: pa.array([shard[name]], pa.binary()) for name in BLOBS},
            })


def build_index(docs: DataFrame, where: str) -> None:
    """Write the index of all ``docs`` (doc_id, text) to a folder."""
    docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _indexer, "docs bigint, words bigint, " + ", ".join(f"{name} binary" for name in BLOBS)
    ).write.parquet(where)


def _terms(row) -> pa.LargeBinaryArray:
    sizes = np.frombuffer(row["term_sizes"], dtype="<i4")
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(row["terms"])])


def _rows(batches):
    """Rows one at a time, as dictionaries of bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _statistics_of(terms: list[bytes]):
    wanted = pa.array(terms, pa.large_binary())

    def run(batches):
        for row in _rows(batches):
            found = pc.index_in(wanted, value_set=_terms(row)).to_numpy(zero_copy_only=False)
            here = np.flatnonzero(~np.isnan(found.astype(np.float64)))
            if len(here) == 0:
                continue
            lists = found[here].astype(np.int64)
            df = np.frombuffer(row["df"], dtype="<i4").astype(np.int64)
            first = np.cumsum(-(-df // BLOCK)) - -(-df // BLOCK)
            tf = np.maximum.reduceat(np.frombuffer(row["block_tf"], dtype="<i4"), first)
            shortest = np.minimum.reduceat(np.frombuffer(row["block_length"], dtype="<i4"), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(here, pa.int32()), pa.array(df[lists]), pa.array(tf[lists], pa.int64()),
                 pa.array(shortest[lists], pa.int64())],
                names=["term", "df", "tf", "shortest"],
            )

    return run


class Corpus:
    """Numbers of the whole corpus: documents with a term, and all terms."""

    def __init__(self, docs: int, words: int):
        self.docs, self.words = docs, words

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths.astype(np.int64) * self.docs // self.words

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return UNIT * tf // (1000 * tf + 12 * norm)


class Shard:
    """The postings of a shard, unpacked by block."""

    def __init__(self, row, corpus: Corpus):
        self.ids = np.frombuffer(row["doc_ids"], dtype="<i8")
        self.nulls = np.frombuffer(row["nulls"], dtype=np.uint8).astype(bool)
        self.norms = corpus.norm(np.frombuffer(row["lengths"], dtype="<i4"))
        self.df = np.frombuffer(row["df"], dtype="<i4").astype(np.int64)
        self.wide = np.frombuffer(row["wide"], dtype=np.uint8).astype(bool)
        blocks = -(-self.df // BLOCK)
        self.first_block = np.append(0, np.cumsum(blocks))
        self.block_first = np.frombuffer(row["block_first"], dtype="<u2")
        self.block_last = np.frombuffer(row["block_last"], dtype="<u2")
        # The best impact that a posting of each block can have.
        self.block_best = impact(
            np.frombuffer(row["block_tf"], dtype="<i4"), corpus.norm(np.frombuffer(row["block_length"], dtype="<i4"))
        )
        # Where a list starts in its streams.
        self.place = np.where(
            self.wide, np.cumsum(self.df * self.wide) - self.df * self.wide, np.cumsum(self.df * ~self.wide) - self.df * ~self.wide
        )
        self.streams = {
            False: (np.frombuffer(row["narrow_docs"], np.uint8), np.frombuffer(row["narrow_tf"], np.uint8)),
            True: (np.frombuffer(row["wide_docs"], "<u2"), np.frombuffer(row["wide_tf"], "<i4")),
        }
        self.unpacked = 0
        self.whole = {}

    def postings(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of some blocks of a list, counted from the list's first block."""
        docs, tf = self.streams[bool(self.wide[term])]
        sizes = np.minimum(BLOCK, self.df[term] - blocks * BLOCK)
        at = self.place[term] + _within(blocks * BLOCK, sizes)
        self.unpacked += len(blocks)
        doc = docs[at].astype(np.int64) + np.repeat(self.block_first[self.first_block[term] + blocks].astype(np.int64), sizes)
        return doc, impact(tf[at], self.norms[doc])

    def full(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list; queries of a block share frequent terms, so it is kept while the shard is searched."""
        if term not in self.whole:
            self.whole[term] = self.postings(term, np.arange(self.first_block[term + 1] - self.first_block[term]))
        return self.whole[term]

    def search(self, lists: list[tuple[int, int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that reach ``floor`` and are above 0.

        ``lists`` are (bound, factor, list); a posting adds factor times its impact, the bound at most.
        """
        lists = sorted(lists)
        upto = np.cumsum([bound for bound, _, _ in lists])
        # Documents that only have terms before this one stay below the floor.
        essential = int(np.searchsorted(upto, floor)) if floor else 0
        scores = np.zeros(len(self.ids), dtype=np.int64)
        for _, factor, term in lists[essential:]:
            doc, best = self.full(term)
            scores[doc] += factor * best
        found = np.flatnonzero(scores)
        for k in range(essential - 1, -1, -1):
            _, factor, term = lists[k]
            rest = int(upto[k - 1]) if k else 0
            found = found[scores[found] + int(upto[k]) >= floor]
            if len(found) == 0:
                break
            a, b = self.first_block[term], self.first_block[term + 1]
            block = np.searchsorted(self.block_last[a:b], found)
            best = np.append(self.block_best[a:b], 0)[block] * factor
            alive = scores[found] + best + rest >= floor
            found, block = found[alive], block[alive]
            inside = block < b - a
            needed = np.unique(block[inside])
            needed = needed[np.isin(needed, block[inside & (found >= np.append(self.block_first[a:b], 0)[block])])]
            if len(needed):
                doc, gain = self.postings(term, needed)
                at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                hit = doc[at] == found
                scores[found[hit]] += factor * gain[at[hit]]
        return found, scores[found]


class Heap:
    """The best documents of a query so far, as small arrays."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores, ids, nulls) -> None:
        kept = scores >= max(self.floor, 1)
        scores = np.concatenate([self.scores, scores[kept]])
        ids, nulls = np.concatenate([self.ids, ids[kept]]), np.concatenate([self.nulls, nulls[kept]])
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def _searcher(items: list, terms: list[bytes], weights: np.ndarray, bounds: np.ndarray, corpus: Corpus, k: int):
    """``items`` are (item id, [(term, times)]); weights and bounds are by term."""
    wanted = pa.array(terms, pa.large_binary())

    def run(batches):
        heaps = [Heap(k) for _ in items]
        for row in _rows(batches):
            shard = Shard(row, corpus)
            found = pc.fill_null(pc.index_in(wanted, value_set=_terms(row)), -1).to_numpy(zero_copy_only=False)
            for heap, (_, needs) in zip(heaps, items):
                lists = [
                    (int(bounds[t]) * times, int(weights[t]) * times, int(found[t])) for t, times in needs if found[t] >= 0
                ]
                if lists:
                    docs, scores = shard.search(lists, heap.floor)
                    heap.add(scores, shard.ids[docs], shard.nulls[docs])
        for heap, (item, _) in zip(heaps, items):
            if len(heap.ids):
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([item] * len(heap.ids), pa.int64()),
                    "doc_id": pa.array(heap.ids, pa.int64(), mask=heap.nulls),
                    "score": pa.array(heap.scores, pa.int64()),
                })

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items."""
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select(
        F.col("item_id").cast("bigint"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")
    )
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def search(index: DataFrame, items: DataFrame, where: str, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents; ``where`` is a folder for intermediate rows."""
    spark = index.sparkSession
    query_terms(items).write.parquet(f"{where}/terms")
    needs = spark.read.parquet(f"{where}/terms")
    size = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    corpus = Corpus(size["docs"] or 0, size["words"] or 0)
    blocks = -(-needs.count() // QUERY_ROWS) if corpus.docs else 0
    heaps = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for number in range(blocks):
        # A block of queries is bounded by ``QUERY_ROWS`` and goes to all shards.
        rows = needs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        terms = sorted({r["term"].encode() for r in rows})
        place = {t: i for i, t in enumerate(terms)}
        totals = (
            index.select(*STATISTICS).mapInArrow(_statistics_of(terms), "term int, df bigint, tf bigint, shortest bigint")
            .groupBy("term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("shortest").alias("shortest"))
        ).collect()
        weights, bounds = np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        for r in totals:
            weights[r["term"]] = corpus.weight(r["df"])
            best = impact(np.array([r["tf"]]), corpus.norm(np.array([r["shortest"]])))[0]
            bounds[r["term"]] = weights[r["term"]] * best
        items_here = {}
        for r in rows:
            # A weight of 0 adds nothing.
            if weights[place[r["term"].encode()]]:
                items_here.setdefault(r["item_id"], []).append((place[r["term"].encode()], r["times"]))
        index.select(*BLOBS).mapInArrow(
            _searcher(sorted(items_here.items(), key=lambda x: (x[0] is None, x[0])), terms, weights, bounds, corpus, k),
            "item_id bigint, doc_id bigint, score bigint",
        ).write.mode("append").parquet(f"{where}/heaps")
        heaps = spark.read.parquet(f"{where}/heaps")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    where = scratch_path(docs.sparkSession, "lexical")
    build_index(docs, f"{where}/index")
    return search(docs.sparkSession.read.parquet(f"{where}/index"), items, where, k)


SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), sizes AS (
  SELECT row, doc_id, CAST(len(t) AS BIGINT) AS n FROM found WHERE len(t) > 0
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM found) GROUP BY ALL
), needs AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, corpus WHERE term IN (SELECT term FROM needs) GROUP BY term, docs
), scored AS (
  SELECT item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS score
  FROM needs JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (row), corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
         doc_id, CAST(score AS BIGINT) AS score
  FROM scored JOIN sizes USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
