"""Exact substring dedup with suffix arrays: removes each byte of a 50-byte string that starts in an earlier document too.

Copies of a whole text are found by their digests. All other texts go through three steps that together are exact:

1. Each 50-byte window has an anchor, the 20-byte string in it with the least hash. Equal windows have equal anchors, so a window
   whose anchor occurs in one text only cannot repeat. Anchors are counted over all texts (four bytes each, in buckets
   that grow in number with the data; a false hit only costs work).
2. Runs of windows with one repeated anchor, 82 bytes at most, go to the group of their anchor; equal runs of a block of
   documents are sent once, with the least doc_id. A group cuts its distinct runs into shards. Each shard's windows are
   sorted into a suffix array by Larsson-Sadakane refinement (ranks of 8, 16, 32 and 50 bytes, only groups that are still
   unsorted are sorted again), their common prefixes come from Kasai's method over all runs side by side, and equal
   windows are neighbours with 50 common bytes. The sorted windows of the shards are merged by binary search.
3. Every window learns the least doc_id that holds it; blocks of documents remove what windows of smaller ids cover.

A frequent passage is sent once per block, so a group gets one row per block of it and no task holds its documents.

Defined results: a null text is empty; texts under 50 bytes lose nothing; a null doc_id counts as larger than all others; rows with
one doc_id do not remove each other's bytes. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrow import flat_bytes, slices

LENGTH = 50
ANCHOR = 20
SPAN = LENGTH - ANCHOR + 1
# Windows of a run at most, and bytes of such a run.
RUN = 33
WIDTH = RUN + LENGTH - 1
# A task's memory: about a hundred times a chunk, twenty times a block, ten times a bucket.
CHUNK = 512 << 10
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
GROUP_BYTES = 3 << 20
SHARD_RUNS = 10_000
LAST = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _loads(data: np.ndarray, at: int, n: int, kind: str) -> np.ndarray:
    """Overlapping little-endian numbers that start at each byte."""
    return np.ndarray((n,), dtype=kind, buffer=data.data, offset=at, strides=(1,))


def anchor_runs(bounds: np.ndarray, data: np.ndarray):
    """(first window, window behind the last, anchor hash) of the runs of texts that stand behind each other in ``data``."""
    empty = np.zeros(0, dtype=np.int64)
    n = len(data) - ANCHOR + 1
    if len(data) < LENGTH:
        return empty, empty, empty.astype(np.uint64)
    h = (_loads(data, 0, n, "<u8") ^ _C) * _A
    h ^= h >> np.uint64(32)
    h += _loads(data, 8, n, "<u8")
    h *= _B
    h ^= h >> np.uint64(29)
    h += _loads(data, 16, n, "<u4")
    h *= _A
    h ^= h >> np.uint64(32)
    h *= _C
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    anchors = h[(least & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    # Windows that end in their text.
    usable = np.zeros(len(anchors) + 1, dtype=np.int8)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes >= LENGTH)
    usable[bounds[full]] += 1
    usable[bounds[full + 1] - LENGTH + 1] -= 1
    usable = np.cumsum(usable[:-1], dtype=np.int8).astype(bool)
    edge = np.ones(len(anchors), dtype=bool)
    edge[1:] = (anchors[1:] != anchors[:-1]) | (usable[1:] != usable[:-1])
    edge[bounds[full]] = True
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], len(anchors))
    good = usable[starts]
    starts, stops = starts[good], stops[good]
    # Even texts have long runs; they are cut.
    parts = -(-(stops - starts) // RUN)
    if len(parts) and parts.max() > 1:
        owner = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        stops = np.minimum(starts[owner] + (nth + 1) * RUN, stops[owner])
        starts = starts[owner] + nth * RUN
    return starts, stops, anchors[starts]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    # Anchors are least hashes, so their leading bits are low: a bucket comes from mixed bits.
    return (((h * _A) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return (((h * _B) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def _cuts(sorted_keys: np.ndarray):
    """(key, begin, end) of the runs of equal keys."""
    if not len(sorted_keys):
        return
    edges = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(sorted_keys)).tolist()):
        yield int(sorted_keys[a]), a, b


def _anchors(buckets: int):
    """Step 1, map side: the anchors of texts, packed per bucket: text digests, blocks and counts, then four bytes per anchor."""

    def run(batches):
        for part in slices(batches, max_bytes=CHUNK):
            bounds, data = flat_bytes(part.column("text"))
            starts, _, h = anchor_runs(bounds, data)
            owner = np.searchsorted(bounds, starts, side="right") - 1
            blocks = np.asarray(part.column("block"), dtype=np.int32)
            raw = data.tobytes()
            digests = np.array(
                [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], dtype=np.uint64
            )
            bucket = _bucket(h, buckets)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for key, a, b in _cuts(bucket[order]):
                mine = order[a:b]
                texts, counts = np.unique(owner[mine], return_counts=True)
                rows.append((key, digests[texts].tobytes(), blocks[texts].tobytes(), counts.astype(np.int32).tobytes(),
                             h[mine].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]],
                names=["bucket", "digests", "blocks", "counts", "anchors"],
            )

    return run


def _repeated(key, table):
    """Step 1, reduce side: per block the anchors of its texts that two different texts have."""
    texts = [np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(n)]) for n, t in
             (("digests", np.uint64), ("blocks", np.int32), ("counts", np.int32))]
    anchors = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("anchors")])
    owner = np.repeat(np.arange(len(texts[0])), texts[2])
    order = np.argsort(anchors, kind="stable")
    ranked, digests = anchors[order], texts[0][owner[order]]
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    several = np.minimum.reduceat(digests, edges) != np.maximum.reduceat(digests, edges)
    hit = np.repeat(several, np.diff(np.append(edges, len(ranked))))
    # (block, anchor) of the hits, each once.
    pairs = np.unique((texts[1][owner[order[hit]]].astype(np.uint64) << np.uint64(32)) | ranked[hit])
    blocks, low = (pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32)
    rows = [(block, low[a:b].tobytes()) for block, a, b in _cuts(blocks)]
    n = len(rows)
    return _notes([r[0] for r in rows], [0] * n, [key[0].as_py()] * n, [None] * n, [r[1] for r in rows])


_NOTE = "block int, kind int, part int, doc bigint, data binary"


def _notes(block, kind, part, doc, data) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()),
                     "doc": pa.array(doc, pa.int64()), "data": pa.array(data, pa.binary())})


class _Block:
    """The texts of a block in a fixed order, and their runs with repeated anchors."""

    def __init__(self, docs, notes, buckets: int, groups: int):
        ids = docs.column("doc_id").fill_null(LAST) if docs.num_rows else docs.column("doc_id")
        docs = docs.append_column("_order", ids).sort_by([("_order", "ascending"), ("text", "ascending")])
        self.table = docs
        self.ids = np.asarray(docs.column("_order"), dtype=np.int64)
        self.bounds, self.data = flat_bytes(docs.column("text"))
        kinds, parts = notes.column("kind").to_pylist(), notes.column("part").to_pylist()
        # Null ids are one id and an id may have several texts, so a copy is known by its id and its text.
        copies = {(d, x) for d, x, k in zip(notes.column("doc").to_pylist(), notes.column("data").to_pylist(), kinds) if k == 1}
        self.copy = np.isin(self.ids, np.array([d for d, _ in copies], dtype=np.int64))
        for i in np.flatnonzero(self.copy).tolist():
            text = self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()
            self.copy[i] = (int(self.ids[i]), hashlib.sha256(text).digest()) in copies
        known = [np.frombuffer(notes.column("data")[i].as_py(), np.uint32).astype(np.uint64) | np.uint64(parts[i] << 32)
                 for i, k in enumerate(kinds) if k == 0]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, dtype=np.uint64)
        found = []
        at = 0
        while at < len(self.ids) and len(known):
            stop = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + CHUNK, side="right")) - 1)
            base = self.bounds[at]
            starts, stops, h = anchor_runs(self.bounds[at : stop + 1] - base, self.data[base : self.bounds[stop]])
            key = (_bucket(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            owner = np.searchsorted(self.bounds, starts + base, side="right") - 1
            good = (known[place] == key) & ~self.copy[owner]
            found.append((starts[good] + base, stops[good] + base, h[good], owner[good]))
            at = stop
        if found:
            self.starts, self.stops, h, self.owner = [np.concatenate(x) for x in zip(*found)]
        else:
            self.starts = self.stops = self.owner = np.zeros(0, dtype=np.int64)
            h = np.zeros(0, dtype=np.uint64)
        self.group = _group(h, groups).astype(np.int64)

    def by_group(self):
        """(group, its runs, code of each run, distinct runs as a binary array); equal in every call."""
        order = np.argsort(self.group, kind="stable")
        for group, a, b in _cuts(self.group[order]):
            mine = order[a:b]
            sizes = self.stops[mine] - self.starts[mine] + LENGTH - 1
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(self.starts[mine] - (ends - sizes), sizes)
            flat = self.data[places]
            runs = pa.BinaryArray.from_buffers(
                pa.binary(), len(mine), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)]
            ).dictionary_encode()
            yield group, mine, runs.indices.to_numpy(zero_copy_only=False), runs.dictionary


def _send(buckets: int, groups: int):
    """Step 2, map side: the distinct runs of a block, per group, with the least id that has them."""

    def run(key, docs, notes):
        block = _Block(docs, notes, buckets, groups)
        rows = []
        for group, mine, codes, distinct in block.by_group():
            least = np.full(len(distinct), LAST, dtype=np.int64)
            np.minimum.at(least, codes, block.ids[block.owner[mine]])
            _, offsets, data = distinct.buffers()
            sizes = np.diff(np.frombuffer(offsets, np.int32)[: len(distinct) + 1]).astype(np.uint8)
            rows.append((group, sizes.tobytes(), data.to_pybytes()[: int(sizes.sum(dtype=np.int64))], least.tobytes()))
        n = len(rows)
        return pa.table({
            "group": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([key[0].as_py()] * n, pa.int32()),
            **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in ((1, "sizes"), (2, "runs"), (3, "least"))},
        })

    return run


def sorted_windows(text: np.ndarray, sizes: np.ndarray):
    """(starts of windows in order, common prefix with the one before) of runs in rows of ``text``, padded by zeros.

    Larsson-Sadakane: suffixes have the rank of their group; a group that is not alone is sorted by the rank one depth further.
    """
    rows, width = text.shape
    flat = np.concatenate([text.reshape(-1), np.zeros(2 * LENGTH, dtype=np.uint8)])
    n = rows * width
    key = np.ndarray((n,), dtype=">u8", buffer=flat.data, strides=(1,)).astype(np.uint64)
    # Only suffixes inside the runs take part.
    inside = np.flatnonzero(text.reshape(-1))
    order = inside[np.argsort(key[inside])]
    ranked = key[order]
    rank = np.zeros(n + 2 * LENGTH, dtype=np.int64)
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    group = np.repeat(edges, np.diff(np.append(edges, len(order))))
    rank[order] = group + 1
    for ahead in (8, 16, LENGTH - 32):
        alone = np.append(group[1:] != group[:-1], True) & np.append(True, group[1:] != group[:-1])
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        suffixes = order[open_at]
        pair = (group[open_at].astype(np.uint64) << np.uint64(32)) | rank[suffixes + ahead].astype(np.uint64)
        resorted = np.argsort(pair)
        pair, suffixes = pair[resorted], suffixes[resorted]
        order[open_at] = suffixes
        # Groups keep their places, so a new group starts where the pair changes.
        new = np.append(True, pair[1:] != pair[:-1])
        group[open_at] = np.maximum.accumulate(np.where(new, open_at, 0))
        rank[suffixes] = group[open_at] + 1
    windows = np.zeros(n, dtype=bool)
    count = sizes.astype(np.int64) - LENGTH + 1
    base = np.arange(rows) * width
    for k in range(int(count.max())):
        windows[base[count > k] + k] = True
    order = order[windows[order]]
    return order, _kasai(flat, order, base, count)


def _kasai(flat: np.ndarray, order: np.ndarray, base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Common prefix, up to 50 bytes, of each window with the one before: from left to right in all runs side by side.

    If the successors of a window and of the one before it in the order stand in the same order, the next window has at most
    one common byte less, and these bytes are not compared again.
    """
    place = np.full(len(flat) + 1, -1, dtype=np.int64)
    place[order] = np.arange(len(order))
    before = np.full(len(flat), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(flat), dtype=np.int8)
    length = np.zeros(len(base), dtype=np.int64)
    for k in range(int(count.max())):
        lanes = np.flatnonzero(count > k)
        at = base[lanes] + k
        other = before[at]
        now = np.zeros(len(lanes), dtype=np.int64)
        if k:
            follows = place[before[at - 1] + 1]
            carry = (before[at - 1] >= 0) & (follows >= 0) & (follows < place[at])
            now[carry] = np.maximum(length[lanes[carry]] - 1, 0)
        going = np.flatnonzero(other >= 0)
        while len(going):
            a, b, size = at[going], other[going], now[going]
            going = going[(size < LENGTH) & (flat[a + size] == flat[b + size])]
            now[going] += 1
        length[lanes] = now
        common[at] = now
    return common[order]


def _shard(text: np.ndarray, sizes: np.ndarray, least: np.ndarray):
    """(sorted distinct windows, least id of each, [run, window] number of the distinct window)."""
    width = text.shape[1]
    order, common = sorted_windows(text, sizes)
    edges = np.flatnonzero(np.append(True, common[1:] < LENGTH))
    ids = np.minimum.reduceat(least[order // width], edges)
    number = np.full(text.shape[0] * width, -1, dtype=np.int64)
    number[order] = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(order))))
    firsts = order[edges]
    strings = np.lib.stride_tricks.sliding_window_view(text.reshape(-1), LENGTH)[firsts]
    return np.ascontiguousarray(strings).view(f"S{LENGTH}").reshape(-1), ids, number.reshape(text.shape)


def least_ids(distinct, least: np.ndarray, shard_runs: int = SHARD_RUNS) -> tuple[np.ndarray, np.ndarray]:
    """([run, window] least id that has the window, windows per run) of distinct runs (a binary array)."""
    _, offsets, data = distinct.buffers()
    bounds = np.frombuffer(offsets, np.int32)[: len(distinct) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    sizes = np.diff(bounds)
    shards = []
    for a in range(0, len(sizes), shard_runs):
        size = sizes[a : a + shard_runs]
        place = bounds[a : a + len(size)][:, None] + np.arange(WIDTH + 1)
        real = np.arange(WIDTH + 1) < size[:, None]
        # Bytes move up by one, so that zero only pads; UTF-8 has no byte 255.
        text = np.where(real, data[np.minimum(place, len(data) - 1)] + np.uint8(1), np.uint8(0))
        shards.append(_shard(text, size, least[a : a + len(size)]))
    # Merging: the sorted windows of each shard are searched in those of the others.
    best = [ids.copy() for _, ids, _ in shards]
    for i, (mine, _, _) in enumerate(shards):
        for j, (other, ids, _) in enumerate(shards):
            if i != j:
                place = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                same = other[place] == mine
                best[i][same] = np.minimum(best[i][same], ids[place[same]])
    out = np.full((len(sizes), RUN), LAST, dtype=np.int64)
    for k, (_, _, number) in enumerate(shards):
        part = number[:, :RUN]
        out[k * shard_runs : k * shard_runs + len(part)] = np.where(part >= 0, best[k][part], LAST)
    return out, sizes - LENGTH + 1


def _answer(key, table):
    """Step 2, reduce side: for the runs of each block, pieces of windows with one least id: (windows, id)."""
    blobs = b"".join(x.as_py() for x in table.column("runs"))
    each = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("sizes")]
    sizes = np.concatenate(each).astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(blobs)])
    runs = runs.dictionary_encode()
    codes = runs.indices.to_numpy(zero_copy_only=False)
    sent = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("least")])
    least = np.full(len(runs.dictionary), LAST, dtype=np.int64)
    np.minimum.at(least, codes, sent)
    ids, count = least_ids(runs.dictionary.cast(pa.binary()), least)
    # Pieces of equal ids within a run.
    real = np.arange(RUN) < count[:, None]
    edge = real.copy()
    edge[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    pieces = edge.sum(axis=1)
    at = np.flatnonzero(edge.reshape(-1))
    row = at // RUN
    end = np.where(np.append(row[1:] == row[:-1], False), np.append(at[1:], 0), row * RUN + count[row])
    firsts = np.cumsum(pieces) - pieces
    lengths, values = (end - at).astype(np.uint8), ids.reshape(-1)[at]
    out, begin = [], 0
    for part in each:
        mine = codes[begin : begin + len(part)]
        begin += len(part)
        n = pieces[mine]
        upto = np.cumsum(n)
        places = np.arange(upto[-1]) + np.repeat(firsts[mine] - (upto - n), n)
        out.append(n.astype(np.uint8).tobytes() + lengths[places].tobytes() + values[places].tobytes())
    n = len(each)
    return _notes(table.column("block").to_pylist(), [2] * n, [key[0].as_py()] * n, [None] * n, out)


def _remove(buckets: int, groups: int):
    """Step 3: cut the covered bytes out of the texts of a block."""

    def run(key, docs, notes):
        block = _Block(docs, notes, buckets, groups)
        answers = {p: i for i, (k, p) in enumerate(zip(notes.column("kind").to_pylist(), notes.column("part").to_pylist())) if k == 2}
        change = np.zeros(len(block.data) + 1, dtype=np.int32)
        for group, mine, codes, distinct in block.by_group():
            raw = notes.column("data")[answers[group]].as_py()
            pieces = np.frombuffer(raw, np.uint8, len(distinct)).astype(np.int64)
            total = int(pieces.sum())
            lengths = np.frombuffer(raw, np.uint8, total, len(distinct)).astype(np.int64)
            values = np.frombuffer(raw, np.int64, total, len(distinct) + total)
            firsts = np.cumsum(pieces) - pieces
            # Windows of a run before each of its pieces.
            ahead = np.cumsum(lengths) - lengths
            ahead -= np.repeat(ahead[firsts], pieces)
            n = pieces[codes]
            upto = np.cumsum(n)
            places = np.arange(upto[-1]) + np.repeat(firsts[codes] - (upto - n), n)
            run_of = np.repeat(mine, n)
            covered = values[places] < block.ids[block.owner[run_of]]
            begin = (block.starts[run_of] + ahead[places])[covered]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + lengths[places][covered] + LENGTH - 1, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        rows = []
        for i, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())):
            part = gone[a:b]
            if block.copy[i] and b - a >= LENGTH:
                rows.append((b - a, b - a, 1, b""))
                continue
            removed = int(np.count_nonzero(part))
            spans = int(part[0]) + int(np.count_nonzero(part[1:] > part[:-1])) if removed else 0
            rows.append((b - a, removed, spans, block.data[a:b][~part].tobytes() if removed else block.data[a:b].tobytes()))
        return pa.table({
            "doc_id": block.table.column("doc_id").cast(pa.int64()),
            **{n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("n_bytes", "n_removed", "n_spans"))},
            "kept": pa.array([r[3] for r in rows], pa.binary()),
        })

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), one row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets, groups = (max(1, -(-size // n)) for n in (BLOCK_BYTES, BUCKET_BYTES, GROUP_BYTES))
    owner = F.coalesce("doc_id", F.lit(LAST))
    docs = docs.withColumn("block", F.pmod(F.xxhash64(owner), F.lit(blocks)).cast("int"))
    digests = docs.select("block", owner.alias("doc"), F.unhex(F.sha2("text", 256)).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = digests.join(firsts, "digest").where("doc > first").select(
        "block", F.lit(1).alias("kind"), F.lit(0).alias("part"), "doc", F.col("digest").alias("data")
    )
    anchors = docs.select("block", "text").mapInArrow(
        _anchors(buckets), "bucket int, digests binary, blocks binary, counts binary, anchors binary"
    )
    # Both passes over the blocks need the notes: written once, they are not computed twice.
    where = scratch_path(docs.sparkSession, "suffix-notes")
    anchors.groupBy("bucket").applyInArrow(_repeated, _NOTE).write.parquet(where)
    copies.write.mode("append").parquet(where)
    notes = docs.sparkSession.read.schema(_NOTE).parquet(where)
    by_block = docs.groupBy("block")
    sent = by_block.cogroup(notes.groupBy("block")).applyInArrow(
        _send(buckets, groups), "group int, block int, sizes binary, runs binary, least binary"
    )
    answers = sent.groupBy("group").applyInArrow(_answer, _NOTE)
    return by_block.cogroup(notes.unionByName(answers).groupBy("block")).applyInArrow(
        _remove(buckets, groups), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
