"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

A document is its token ids and the end id; one longer than a sequence is cut into whole sequences, and its first piece is what
is over. The plan never sees a document: lengths are taken from the longest down, each with its count, and the pieces of one
length go as runs to the sequences with the least room that fits. Sequences with equal room are segments of numbers, so a
run takes or splits a whole segment; a taken segment's room at least halves, which bounds the plan by about
``3 * limit * log2(limit)`` runs whatever the corpus (3 MB at 2,048 tokens).

Pieces are then numbered within their length without gathering a length anywhere: a task counts its own pieces, the counts
per (task, length) are summed up, and a piece's rank is its task's start plus its place there. It joins the plan on
(length, rank div ``CELL``) and takes the slot whose run holds its rank, so no key of the join has more than ``CELL`` pieces.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed like any other row; pieces of
one length are alike to the plan, and which of them takes which slot follows the order of the stored rows; a very long text
is encoded whole and then cut; an empty table has no pieces. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrow import process_cache, slices, strings
from .id_files import PieceIds

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 2048
CELL = 1024


def plan_lengths(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, next rank, first sequence, pieces per sequence, offset) of best fit, longest first."""
    runs, rooms = [], []  # rooms in use, ascending
    open_at = defaultdict(list)  # room: segments (first sequence, how many)
    sequences = 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if not open_at[room]:
                bisect.insort(rooms, room)
            open_at[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_at[room].pop()
                if not open_at[room]:
                    rooms.pop(at)
            else:
                room = limit
                first, count = sequences, -(-left // (limit // length))
                sequences += count
            each = room // length
            taken = min(count, -(-left // each))
            placed = min(left, taken * each)
            runs.append((length, rank, rank + placed, first, each, limit - room))
            leave(room, first + taken, count - taken)
            full, rest = divmod(placed, each)
            leave(room - each * length, first, full)
            leave(room - rest * length, first + full, int(rest > 0))
            rank, left = rank + placed, left - placed
    return runs


def _cut_lengths(counts: np.ndarray, limit: int):
    """(document, piece, start, length) of all pieces of documents with these numbers of ids."""
    pieces = -(-counts // limit)
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    over = (counts - (pieces - 1) * limit)[owner]
    return owner, number, np.where(number == 0, 0, over + (number - 1) * limit), np.where(number == 0, over, limit)


def _encoder(tokenizer: str, path: str, limit: int):
    def run(batches):
        encode = process_cache(f"piece_ids_{tokenizer}", lambda: PieceIds(path))
        task = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, dtype=np.int64)
        for part in slices(batches):
            ids, counts = encode(strings(part.column("text")))
            owner, number, start, length = _cut_lengths(counts, limit)
            begin = (np.cumsum(counts) - counts)[owner] + start
            flat = ids.astype("<u4")
            sums = [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            place = np.empty(len(length), dtype=np.int64)
            place[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=limit + 1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array(owner)), "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()), "task": pa.array(np.full(len(owner), task), pa.int32()),
                "place": pa.array(place, pa.int64()),
            })

    return run


def cut_documents(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents, with the task that made them and their place among its pieces of that length."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _encoder(tokenizer, public_tokenizers.path(tokenizer), limit),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint",
    )


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (stored; with length, task and place) with sequence_id and offset instead of task and place."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("_n"))
    # At most ``limit`` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan_lengths(histogram, limit),
        "length bigint, first_rank bigint, next_rank bigint, first_sequence bigint, each bigint, offset bigint",
    )
    cells = runs.select(
        F.col("length").alias("_length"),
        F.explode(F.expr(f"sequence(first_rank div {CELL}, (next_rank - 1) div {CELL})")).alias("_cell"),
        F.struct("first_rank", "next_rank", "first_sequence", "each", "offset").alias("_run"),
    )
    slots = cells.groupBy("_length", "_cell").agg(F.collect_list("_run").alias("_runs"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("task").alias("_task"), F.col("length").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    ranked = pieces.join(
        starts, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_of"))
    ).withColumn("_rank", F.col("_before") + F.col("place"))
    placed = ranked.join(
        slots, (F.col("length") == F.col("_length")) & (F.expr(f"_rank div {CELL}") == F.col("_cell"))
    ).withColumn(
        "_run", F.get(F.filter("_runs", lambda r: (r["first_rank"] <= F.col("_rank")) & (F.col("_rank") < r["next_rank"])), F.lit(0))
    ).withColumn("_step", F.col("_rank") - F.col("_run.first_rank"))
    return placed.select(
        *[c for c in pieces.columns if c not in ("task", "place")],
        F.expr("_run.first_sequence + _step div _run.each").alias("sequence_id"),
        F.expr("_run.offset + (_step % _run.each) * length").alias("offset"),
    )


def report(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    where = scratch_path(docs.sparkSession, "packing")
    # Stored once: ranks hold for the rows as they were written.
    cut_documents(docs, limit, tokenizer).write.parquet(where)
    return pack(docs.sparkSession.read.parquet(where), limit)
